"""Near-duplicate embeddings through a pivot-permutation index.

Reference points (pivots) are taken from a bounded sample of the vectors, no two of them near copies of each other. Every vector
is described by its nearest pivots in their order. Vectors are filed in inverted lists of pivots; two vectors that meet in a list
have their shared pivots counted, and where enough are shared the cosine is verified in double precision.

A vector need not be filed under all its pivots: if two vectors share ``shared`` of ``nearest`` pivots, they share ``t`` among the
first ``nearest - shared + t`` of each, ordered by the length of the lists, shortest first. Lists are kept for single pivots
(t = 1) or, where those would outgrow a block, for pairs or triples of them; the pairs found are the same for every t. A pair of
vectors is dealt with only in the first list they have in common, so link counts are sums over lists.

Lists are worked through in blocks of bounded size, pair of blocks by pair of blocks, and a block answers with one row per vector
that has links (their number, and a member that it hangs together with), never with the pairs. Equal vectors are one node with
its number of rows, so exact copies cost nothing; a long list of vectors that are near but not equal costs a matrix product per
pair of its blocks, as every link has to be counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencegraph.functions.lineage import cut
from fencegraph.llm.components import connected

SAMPLE, PIVOTS, NEAREST, SHARED = 8192, 512, 12, 7
APART = 0.9  # largest cosine between two pivots
BLOCK_BYTES = 2 << 20  # of vectors in a block
LENGTHS = (1, 2, 3)  # pivots that a list may stand for


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda c: c != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that no square overflows or vanishes."""
    x = rows / np.abs(rows).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, most: int = PIVOTS, apart: float = APART) -> np.ndarray:
    """Unit vectors of ``sample`` in their order, each at a cosine under ``apart`` to those taken before."""
    out = np.zeros((0, sample.shape[1]))
    for v in sample:
        if not len(out) or (out @ v).max() < apart:
            out = np.vstack([out, v])
            if len(out) == most:
                break
    return out


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` nearest pivots of each row, nearest first, ties to the smaller number."""
    near = x @ pivots.T
    few = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1) if k < len(pivots) else np.tile(np.arange(len(pivots)), (len(x), 1))
    order = np.argsort(-np.take_along_axis(near, few, 1), axis=1, kind="stable")
    return np.take_along_axis(few, order, 1)


def list_length(rows: int, block: int, pivots: int, k: int, shared: int) -> int:
    """How many pivots a list should stand for, so that ``rows`` vectors spread evenly would fit a block."""
    for t in LENGTHS:
        per_list = rows
        for i in range(t):
            per_list *= (k - shared + t - i) / max(1, pivots - i)
        if per_list <= block or t >= shared:
            return t
    return LENGTHS[-1]


def _bits(near: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """0/1 rows over ``columns``; numbers that are not among them are ignored."""
    at = np.searchsorted(columns, near)
    at[at == len(columns)] = 0
    out = np.zeros((len(near), len(columns)), np.float32)
    hit = columns[at] == near if len(columns) else np.zeros(near.shape, bool)
    out[np.nonzero(hit)[0], at[hit]] = 1
    return out


def block_links(x: np.ndarray, ranks: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, key: tuple[int, ...], prefix: int, shared: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight linked to each row of a block, and for each row a row of its component, of pairs between ``left`` and ``right``
    (row numbers, the same ones or none in common) whose first common list is ``key``."""
    same = left is right
    columns = np.unique(ranks)
    every = _bits(ranks, columns)
    before = _bits(ranks[:, :prefix], columns[columns < key[-1]])
    degree, part = np.zeros(len(x), np.int64), np.arange(len(x))
    every_r, before_r, x_r = every[right], before[right], x[right]
    for lo in range(0, len(left), 256):
        rows = left[lo : lo + 256]
        met = (every[rows] @ every_r.T >= shared) & (before[rows] @ before_r.T == len(key) - 1)
        if same:
            met[np.arange(len(rows)), lo + np.arange(len(rows))] = False
        if not met.any():
            continue
        met &= x[rows] @ x_r.T >= least
        degree[rows] += met @ weight[right]
        if not same:
            degree[right] += met.T @ weight[rows]
        for i in np.flatnonzero(met.any(axis=1)):
            roots = np.unique(np.append(part[right[met[i]]], part[rows[i]]))
            if len(roots) > 1:
                part[np.isin(part, roots)] = roots[0]
    return degree, part


def links(nodes: DataFrame, *, least: float, sample: int = SAMPLE, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, lists: int | None = None, block: int | None = None) -> DataFrame:
    """(node, root, n) of ``nodes`` (node long, label, v array<double>, n long): rows that add up to the number of linked others,
    and edges to a node of the same component. All vectors have one length, labels are not null."""
    spark = nodes.sparkSession
    taken = [r.v for r in nodes.orderBy(F.xxhash64("node"), "node").limit(sample).select("v").collect()]  # a bounded sample
    found = "node long, root long, n long"
    if not taken:
        return spark.createDataFrame([], found)
    points = choose_pivots(unit(np.array(taken, np.float64)), pivots)
    k = min(nearest, len(points))
    shared = min(shared, k)
    block = block or max(64, BLOCK_BYTES // (8 * points.shape[1]))
    sent = spark.sparkContext.broadcast(points)  # ``pivots`` vectors at most

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                near = nearest_pivots(x, sent.value, k).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), k).cast(pa.list_(pa.int32()))], names=[*batch.schema.names, "near"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + ", near array<int>"
    described = cut(nodes.mapInArrow(describe, shape), "described")
    held = {r.p: r["count"] for r in described.select(F.explode("near").alias("p")).groupBy("p").count().collect()}  # a row per pivot
    rank = np.empty(len(points), np.int32)
    rank[sorted(range(len(points)), key=lambda p: (held.get(p, 0), p))] = np.arange(len(points))
    most = described.groupBy("label").count().agg(F.max("count")).first()[0]
    t = min(lists or list_length(most, block, len(points), k, shared), shared)
    prefix, base = k - shared + t, len(points)
    subsets = np.array(list(combinations(range(prefix), t)))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ranks = np.sort(rank[batch.column("near").flatten().to_numpy().reshape(-1, k)], axis=1)
                keys = np.zeros((len(ranks), len(subsets)), np.int64)
                for i in range(t):
                    keys = keys * base + ranks[:, subsets[:, i]]
                rest = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(kind)) for a, kind in ((ranks, pa.int32()), (keys, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.select(["node", "label", "v", "n"]).columns, *rest], names=["node", "label", "v", "n", "ranks", "keys"])

    label = nodes.schema["label"].dataType.simpleString()
    filed = described.select("node", "label", "v", "n", "near").mapInArrow(file, f"node long, label {label}, v array<double>, n long, ranks array<int>, keys array<bigint>")
    entries = filed.select("node", "label", "v", "n", "ranks", F.explode("keys").alias("key"))
    long_lists = cut(entries.groupBy("label", "key").count().where(F.col("count") > block).select("label", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "long-lists")
    entries = entries.join(long_lists, ["label", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = entries.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = own.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        packed, lo, hi = int(key[1]), key[2], key[3]
        numbers = []
        for _ in range(t):
            packed, r = divmod(packed, base)
            numbers.insert(0, r)
        side = group["own"].to_numpy()
        left = np.flatnonzero(side == lo)
        right = left if lo == hi else np.flatnonzero(side == hi)
        node, weight = group["node"].to_numpy(), group["n"].to_numpy()
        if len(left) and len(right) and len(group) > 1:
            degree, part = block_links(unit(np.array(group["v"].tolist(), np.float64)), np.array(group["ranks"].tolist()), weight, left, right, tuple(numbers), prefix, shared, least)
        else:
            degree, part = np.zeros(len(group), np.int64), np.arange(len(group))
        has = np.flatnonzero(degree)
        return pd.DataFrame({"node": node[has], "root": node[part[has]], "n": degree[has]})

    return paired.groupBy("label", "key", "lo", "hi").applyInPandas(meet, found)


def groups(table: DataFrame, vec_id: str, vector: str, label: str, *, least: float = 0.98, **how) -> DataFrame:
    """A row per row of ``table``: vec_id, n_links (other rows whose vector has a cosine of ``least`` or more, and the same
    label), component_id (smallest id reachable by links, its own included), kept (whether that is its own).

    Rows that repeat a vector, or an id and a vector, are linked like any others. Rows with a null id or label, an unusable
    vector, or one of another length than the commonest link with nothing; they are answered with no links and their own id,
    and are kept. Links are those that the index finds (``tests/llm/test_pivots.py`` measures its recall), and none below
    ``least``. Other columns are ignored.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    common = rows.where(takes_part).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    takes_part = takes_part & (F.size("v") == (common["d"] if common else 0))
    print_of = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]  # 128 bits of a vector
    good = rows.where(takes_part).select("vec_id", "label", "v", *print_of)
    distinct = good.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    nodes = cut(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = cut(links(nodes.select("node", "label", "v", "n"), least=least, **how), "links")
    parts = connected(found.select("node", "root"), "node", "root")
    named = nodes.select("node", "label", "h1", "h2", "first", "n").join(parts.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").withColumn("part", F.coalesce("component", "node")).drop("member", "component")
    degree = found.groupBy(F.col("node").alias("linked")).agg(F.sum("n").alias("links"))
    named = cut(named.join(degree, F.col("node") == F.col("linked"), "left"), "named")
    ids = named.groupBy("part").agg(F.min("first").alias("component_id"))
    of_vector = named.join(ids, "part").select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    answered = good.drop("v").join(of_vector, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(takes_part, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return answered.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
