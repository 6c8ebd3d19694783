"""Byte-level BPE encoding and decoding over overlapping chunks.

Texts longer than ``CHUNK`` characters are cut into chunks that reach ``OVERLAP`` characters into the next one. All chunks
are pre-tokenised in parallel. The pattern looks at nothing before a match, so where a boundary of one chunk is also a
boundary of the next, both agree from there on: the chunks are stitched at the first such place, and the pieces between
stitches are encoded each by itself. Neighbours whose overlap has no common boundary (an endless word) become one piece.
A text of one chunk is one piece. Decoding joins the bytes of the ids.

Inside a task a piece is encoded cell by cell: a space with a character that is no white space on either side of it always
starts a pre-token, whatever stands before, so the text from one such space to the next is encoded once and remembered.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fencegraph.functions.lineage import cut
from fencegraph.llm.common import small_batches, tasks

CHUNK, OVERLAP = 32768, 1024
REMEMBERED = 150_000
_UNSAFE = re.compile(r"\s (?:\s|$)")


class Codec(dict):
    """Ids by cell, remembered for a bounded number of cells."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pattern_text = pattern

    @cached_property
    def library(self) -> tiktoken.Encoding:
        """Only where something is encoded: decoding needs the bytes alone."""
        return tiktoken.Encoding("file", pat_str=self.pattern_text, mergeable_ranks={b: i for i, b in self.bytes_of.items()}, special_tokens={})

    @cached_property
    def pattern(self) -> regex.Pattern:
        return regex.compile(self.pattern_text)

    def __missing__(self, cell: str) -> list[int]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.library.encode_ordinary(cell)
        if len(cell) <= 64:
            self[cell] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.__getitem__, cells(text))), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def boundaries(self, chunk: str) -> list[int]:
        """Ends of the pre-tokens of ``chunk``, without the one at its end."""
        return [m.end() for m in self.pattern.finditer(chunk)][:-1]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def cells(text: str) -> list[str]:
    """Cut before every space that surely starts a pre-token: the character before or after it is no white space."""
    first, *rest = text.split(" ")
    parts = [" " + w for w in rest]
    if first:
        parts.insert(0, first)
    if text[:1].isspace() or _UNSAFE.search(text):
        joined: list[str] = []
        for p in parts:
            follows_space = bool(joined) and joined[-1][-1:].isspace()
            if follows_space and (len(p) == 1 or p[1].isspace()):
                joined[-1] += p
            else:
                joined.append(p)
        return joined
    return parts


def _encoded(df: DataFrame, path: str, pattern: str, out: str) -> DataFrame:
    """Column 0, a text of bounded length, becomes ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                arrays = [c.encode(x.as_py() or "") for x in part.column(0)]
                ends = np.cumsum([0, *map(len, arrays)], dtype=np.int64)
                ids = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)]))).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], ids], names=[*part.schema.names[1:], out])

    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[1:]] + [f"`{out}` array<int>"])
    return df.mapInArrow(work, types)


def _stitches(chunks: DataFrame, path: str, pattern: str) -> DataFrame:
    """(row, k, head, tail, piece): where chunk ``k`` is stitched to the one before and after it, from the start of its own
    and of the next chunk; null where it is not. Chunks of the same ``piece`` belong together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            heads, tails = [], []
            for k, size, body in zip(*(batch.column(n).to_pylist() for n in ("k", "size", "body"))):
                ends = c.boundaries(body)
                sure = 0 if k == 0 else next((m.start() for m in re.finditer(r" (?=\S)", body) if m.start() > 0), len(body))
                heads.append([b for b in ends if b < OVERLAP])
                tails.append([b - size for b in ends if b >= size and b >= sure])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("k"), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=["row", "k", "heads", "tails"]
            )

    seen = chunks.select("row", "k", "size", "body").mapInArrow(work, "row long, k int, heads array<int>, tails array<int>")
    along = Window.partitionBy("row").orderBy("k")
    tail = F.array_min(F.array_intersect("tails", F.lead("heads").over(along)))
    stitched = seen.select("row", "k", tail.alias("tail")).withColumn("head", F.lag("tail").over(along))
    return stitched.withColumn("piece", F.count("head").over(along.rowsBetween(Window.unboundedPreceding, 0)))


def encode(docs: DataFrame, text: str, path: str, pattern: str, out: str = "ids") -> DataFrame:
    """``docs`` without its text, with the ids of the whole text as array<int>.

    Null and empty texts have no ids. Repeated rows are encoded each; special tokens are ordinary text. Columns whose name
    clashes with ``out`` are replaced. ``path`` names the rank file, which every executor must find.
    """
    small_batches(docs.sparkSession)
    kept = docs.drop(text, out)
    names = [f"c{i}" for i in range(len(kept.columns))]
    plain = docs.select(docs[text].alias("text"), *[docs[c].alias(n) for n, c in zip(names, kept.columns)])
    long = F.coalesce(F.length("text") > CHUNK, F.lit(False))
    short_ids = _encoded(plain.where(~long), path, pattern, "ids")
    wide = cut(
        plain.where(long).withColumn("row", F.monotonically_increasing_id())
        .select(*names, "row", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("parts"))
        .select(*names, "row", F.posexplode(F.transform("parts", lambda p, i: F.struct(p.alias("part"), F.left(F.coalesce(F.get("parts", i + 1), F.lit("")), F.lit(OVERLAP)).alias("more")))).alias("k", "c"))
        .select(*[F.when(F.col("k") == 0, F.col(n)).alias(n) for n in names], "row", "k", F.length("c.part").alias("size"), F.concat("c.part", "c.more").alias("body")),
        "chunks",
    )
    spread = wide.repartition(tasks(docs.sparkSession), "row", "k")
    at = _stitches(spread, path, pattern)
    begin, end = F.coalesce("head", F.lit(0)), F.when(F.col("tail").isNull(), F.col("size")).otherwise(F.col("size") + F.col("tail"))
    parts = wide.join(at, ["row", "k"]).select("row", "piece", "k", F.substring("body", begin + 1, end - begin).alias("part"))
    pieces = parts.groupBy("row", "piece").agg(F.sort_array(F.collect_list(F.struct("k", "part"))).alias("parts")).select(F.array_join("parts.part", "").alias("text"), "row", "piece")
    coded = _encoded(pieces, path, pattern, "ids").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("all")).select("row", F.flatten("all.ids").alias("ids"))
    long_ids = wide.where("k = 0").select("row", *names).join(coded, "row").select(*names, "ids")
    return short_ids.select(*names, "ids").unionByName(long_ids).toDF(*kept.columns, out)


def decode(coded: DataFrame, ids: str, path: str, pattern: str, out: str = "bytes") -> DataFrame:
    """All columns of ``coded`` with the joined bytes of its ids. Null ids decode to no bytes; an id that is no rank fails."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                data = [c.decode(x.values.to_pylist() if x.is_valid else []) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=[*part.schema.names, out])

    small_batches(coded.sparkSession)
    kept = coded.drop(out)
    at = kept.columns.index(ids)
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{out}` binary"])
    return kept.mapInArrow(work, types)


def ids_digest(ids: Column) -> Column:
    """sha256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)
