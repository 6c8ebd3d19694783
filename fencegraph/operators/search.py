"""Fenced vector search and cited extractive answers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from fencegraph.functions import keys
from fencegraph.functions import text as X
from fencegraph.functions.ranking import top_rows

DIM = 64
SALTS = 16
BLOCK_ROWS = 4096
NO_ANSWER = "No revealed passages match that query."


@lru_cache(maxsize=1 << 16)
def _slot(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest(), 16) % DIM


@F.pandas_udf(ArrayType(DoubleType()))
def hashed_words(texts: pd.Series) -> pd.Series:
    """Hashed bag of words, 64 slots; the default of the embedder seam."""
    return texts.map(lambda t: np.bincount([_slot(w) for w in t.lower().split()], minlength=DIM).astype(float), na_action="ignore")


def norm2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    return F.transform(F.array(norm2(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0.0 when a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    n = norm2(a) * norm2(b)
    return F.when(n > 0, dot / n).otherwise(F.lit(0.0))


def index_chunks(chunks: DataFrame, embed: Callable[[Column], Column] = hashed_words) -> DataFrame:
    """Stored chunks of a chunk table, told apart by (work_id, chunk_id); ``embed`` is any text -> array<double> column function."""
    cid = keys.in_work(F.col("chapter_ordinal"), F.col("ordinal"))
    return chunks.select(cid.alias("chunk_id"), "work_id", "chapter_ordinal", "char_start", "char_end", "text", embed(F.col("text")).alias("embedding"))


def replace_works(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """Index after rebuilding the works that ``fresh`` holds."""
    return index.join(fresh.select("work_id").distinct(), "work_id", "left_anti").unionByName(fresh)


def upsert_chunks(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """Index after adding chunks; the same chunk of a work is replaced."""
    return index.join(fresh.select("work_id", "chunk_id"), ["work_id", "chunk_id"], "left_anti").unionByName(fresh)


_HITS = StructType([StructField("q_id", ArrayType(LongType())), StructField("chunk_id", ArrayType(LongType())), StructField("score", ArrayType(DoubleType()))])


def _block_scorer(k: int) -> Callable[..., Column]:
    @F.pandas_udf(_HITS)
    def best(q_id: pd.Series, q_n: pd.Series, q_vec: pd.Series, c_id: pd.Series, c_ch: pd.Series, c_vec: pd.Series) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for qi, qn, qv, ci, cc, cv in zip(q_id, q_n, q_vec, c_id, c_ch, c_vec, strict=True):
            by_id = np.argsort(ci, kind="stable")
            ids, q, c = ci[by_id], qv.reshape(len(qi), -1), cv.reshape(len(ci), -1)[by_id]
            size = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1))
            s = np.divide(q @ c.T, size, out=np.zeros_like(size), where=size > 0).round(9)
            s[cc[by_id][None, :] > qn[:, None]] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            val = np.take_along_axis(s, top, axis=1)
            keep = np.isfinite(val)
            out.append((np.broadcast_to(qi[:, None], top.shape)[keep], ids[top][keep], val[keep]))
        return pd.DataFrame({"q_id": [o[0] for o in out], "chunk_id": [o[1] for o in out], "score": [o[2] for o in out]})

    return best


def _cell_scorer(k: int) -> Callable[..., Column]:
    @F.pandas_udf(_HITS)
    def best(q_id: pd.Series, q_n: pd.Series, q_vec: pd.Series, q_cells: pd.Series, c_id: pd.Series, c_ch: pd.Series, c_vec: pd.Series, c_cell: pd.Series) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for qi, qn, qv, qc, ci, cc, cv, cl in zip(q_id, q_n, q_vec, q_cells, c_id, c_ch, c_vec, c_cell, strict=True):
            by_id = np.argsort(ci, kind="stable")
            ids, at, home, q, c, asked = ci[by_id], cc[by_id], cl[by_id], qv.reshape(len(qi), -1), cv.reshape(len(ci), -1)[by_id], qc.reshape(len(qi), -1)
            q_norm, c_norm = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
            s = np.full((len(qi), len(ci)), -np.inf)
            for cell in np.unique(home):
                rows, cols = np.flatnonzero((asked == cell).any(axis=1)), np.flatnonzero(home == cell)
                size = np.outer(q_norm[rows], c_norm[cols])
                near = np.divide(q[rows] @ c[cols].T, size, out=np.zeros_like(size), where=size > 0).round(9)
                near[at[cols][None, :] > qn[rows][:, None]] = -np.inf
                s[np.ix_(rows, cols)] = near
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            val = np.take_along_axis(s, top, axis=1)
            keep = np.isfinite(val)
            out.append((np.broadcast_to(qi[:, None], top.shape)[keep], ids[top][keep], val[keep]))
        return pd.DataFrame({"q_id": [o[0] for o in out], "chunk_id": [o[1] for o in out], "score": [o[2] for o in out]})

    return best


def _pack(df: DataFrame, keys: list[str], id_col: str, at: str, prefix: str, cell: Column | None = None) -> DataFrame:
    """Rows of a block as three flat arrays, or four with that of their cells; a block holds at most ``BLOCK_ROWS`` rows."""
    row = [F.col(id_col).alias("i"), F.col(at).alias("a"), F.col("embedding").cast("array<double>").alias("v"), *([] if cell is None else [cell.alias("c")])]
    p = df.groupBy(*keys).agg(F.collect_list(F.struct(*row)).alias("l"))
    return p.select(
        *keys, F.transform("l", lambda x: x["i"]).alias(f"{prefix}_id"), F.transform("l", lambda x: x["a"]).alias(f"{prefix}_at"),
        F.flatten(F.transform("l", lambda x: x["v"])).alias(f"{prefix}_vec"), *([] if cell is None else [F.flatten(F.transform("l", lambda x: x["c"])).alias(f"{prefix}_cell")]),
    )


def _blocked(chunks: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Chunks with their ``block``: as many of equal size as the chunks of its key fill, whatever their ids look like; and the
    number of blocks of each key."""
    sizes = chunks.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("__blocks"))
    return chunks.join(sizes, on).withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("__blocks"))).drop("__blocks"), sizes


def _search(queries: DataFrame, chunks: DataFrame, k: int, on: list[str], block: Column | None) -> DataFrame:
    """Blocks of queries are repeated as often as their key has blocks, ``SALTS`` times at most."""
    q = queries.withColumn("q_block", F.floor(F.col("q_id") / BLOCK_ROWS))
    qb = _pack(q, [*on, "q_block"], "q_id", "n", "q")
    if block is None:
        c, sizes = _blocked(chunks, on)
        c = c.withColumn("salt", F.pmod("block", F.lit(SALTS)).cast("int"))
        qb = qb.join(sizes, on).withColumn("salt", F.explode(F.sequence(F.lit(0), F.least("__blocks", F.lit(SALTS)).cast("int") - 1))).drop("__blocks")
    else:
        c = chunks.withColumn("block", block).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
        qb = qb.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cb = _pack(c, [*on, "block", "salt"], "chunk_id", "chapter_ordinal", "c")
    hits = cb.join(qb, [*on, "salt"]).select(
        "work_id", _block_scorer(k)(F.col("q_id"), F.col("q_at"), F.col("q_vec"), F.col("c_id"), F.col("c_at"), F.col("c_vec")).alias("h")
    )
    return _flat(hits)


def _flat(hits: DataFrame) -> DataFrame:
    return hits.select("work_id", F.explode(F.arrays_zip("h.q_id", "h.chunk_id", "h.score")).alias("z")).select("work_id", "z.q_id", "z.chunk_id", "z.score")


def best_in_blocks(queries: DataFrame, chunks: DataFrame, k: int, on: list[str]) -> DataFrame:
    """(q_id, work_id, chunk_id, score): the ``k`` best of each query and block among fenced chunks that agree on ``on``."""
    return _search(queries, chunks, k, on, None)


def best_in_cells(queries: DataFrame, chunks: DataFrame, k: int, groups: int) -> DataFrame:
    """(q_id, work_id, chunk_id, score): the ``k`` best of each query and block among fenced chunks of its work that lie in one of its ``cells``
    (the same number for each query).

    Cells are dealt into ``groups``, ``SALTS`` at most, and a block of queries goes once to each group, however many cells its queries visit;
    there each cell meets the queries that visit it.
    """
    groups = max(1, min(groups, SALTS))
    qb = _pack(queries.withColumn("q_block", F.floor(F.col("q_id") / BLOCK_ROWS)), ["work_id", "q_block"], "q_id", "n", "q", F.col("cells"))
    c, sizes = _blocked(chunks.withColumn("salt", F.pmod("cell", F.lit(groups))), ["work_id", "salt"])
    cb = _pack(c, ["work_id", "salt", "block"], "chunk_id", "chapter_ordinal", "c", F.array("cell"))
    met = sizes.groupBy("work_id").agg(F.collect_set("salt").alias("salts"))
    qb = qb.join(met, "work_id").withColumn("salt", F.explode("salts")).drop("salts")
    best = _cell_scorer(k)(*[F.col(f"q_{x}") for x in ("id", "at", "vec", "cell")], *[F.col(f"c_{x}") for x in ("id", "at", "vec", "cell")])
    return _flat(cb.join(qb, ["work_id", "salt"]).select("work_id", best.alias("h")))


def top_k(queries: DataFrame, chunks: DataFrame, k: int, block: Column | None = None) -> DataFrame:
    """Exact fenced top-k of many queries: (q_id, work_id, chunk_id, score, rank).

    ``queries``: q_id, work_id, n, embedding. Chunks are packed into blocks of bounded size, spread over
    salts so that a hot work fills many tasks; each block meets the query blocks of its work and returns at
    most k rows per query from one matrix product. No pair of query and chunk ever becomes a row. The
    fence is applied before ranking. Scores are rounded to 9 places; ties go to the lower chunk id.
    """
    flat = _search(queries, chunks, k, ["work_id"], block)
    return top_rows(flat, ["q_id", "work_id"], [F.desc("score"), F.col("chunk_id")], k)


def planes(count: int, dim: int = DIM) -> list[list[int]]:
    """Fixed hyperplanes of +-1 entries, from md5 bits of the plane and the coordinate."""
    return [[1 if int(hashlib.md5(f"{p}:{i}".encode()).hexdigest()[0], 16) % 2 else -1 for i in range(dim)] for p in range(count)]


def cell(v: Column, count: int) -> Column:
    """Which side of each hyperplane a vector lies on, as a number."""
    bits = [
        F.when(F.aggregate(F.zip_with(v, F.lit(p), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x) > 0, F.lit(1 << b)).otherwise(F.lit(0))
        for b, p in enumerate(planes(count))
    ]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total


def approx_top_k(queries: DataFrame, chunks: DataFrame, k: int, *, bits: int = 3, block: Column | None = None) -> DataFrame:
    """Approximate fenced top-k: only chunks in the query's cell or one hyperplane away are scored, exactly."""
    c = chunks.withColumn("cell", cell(F.col("embedding"), bits))
    own = cell(F.col("embedding"), bits)
    probes = F.transform(F.array(own), lambda o: F.concat(F.array(o), F.array(*[o.bitwiseXOR(F.lit(1 << b)) for b in range(bits)])))[0]
    q = queries.withColumn("cell", F.explode(probes))
    flat = _search(q, c, k, ["work_id", "cell"], block)
    return top_rows(flat, ["q_id", "work_id"], [F.desc("score"), F.col("chunk_id")], k)


# ------------------------------------------------------------------ answers


def keywords(text: Column) -> Column:
    """Distinct lower-case words of letters and digits longer than two."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2))


def best_sentence(text: Column, words: Column) -> Column:
    """The sentence that shares most distinct keywords with ``words`` (first on ties); the text if it has none."""
    said = F.filter(F.transform(F.regexp_extract_all(text, F.lit("[^.!?]+[.!?]?"), F.lit(0)), X.strip_ws), lambda s: s != "")
    scored = F.transform(said, lambda s, i: F.struct(F.size(F.array_intersect(keywords(s), words)).alias("n"), (-i).alias("at"), s.alias("s")))
    return F.coalesce(F.array_max(scored)["s"], X.strip_ws(text))


def compose_answers(queries: DataFrame, hits: DataFrame, chunks: DataFrame, max_passages: int = 3) -> DataFrame:
    """(q_id, work_id, answer, citations) per query; queries without hits get the fixed text.

    ``queries``: q_id, work_id, query; ``hits``: q_id, work_id, chunk_id, rank.
    """
    used = hits.filter(F.col("rank") <= max_passages).join(
        chunks.select("work_id", "chunk_id", "chapter_ordinal", "char_start", "char_end", "text"), ["work_id", "chunk_id"]
    ).join(queries.select("q_id", "work_id", keywords(F.col("query")).alias("words")), ["q_id", "work_id"])
    part = F.concat(best_sentence(F.col("text"), F.col("words")), F.lit(" [ch"), F.col("chapter_ordinal").cast("string"), F.lit("]"))
    rows = used.groupBy("q_id", "work_id").agg(  # at most max_passages rows each
        F.sort_array(F.collect_list(F.struct("rank", part.alias("part"), F.struct("chunk_id", "chapter_ordinal", "char_start", "char_end").alias("c")))).alias("l")
    )
    return queries.select("q_id", "work_id").join(rows, ["q_id", "work_id"], "left").select(
        "q_id", "work_id", F.coalesce(F.array_join(F.transform("l", lambda x: x["part"]), " "), F.lit(NO_ANSWER)).alias("answer"),
        F.transform("l", lambda x: x["c"]).alias("citations"),
    )
