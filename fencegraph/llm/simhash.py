"""SimHash near-duplicates through multi-index hashing.

A 64-bit fingerprint has two segments of 32 bits. If two fingerprints differ in at most two bits, they differ in at most
one bit of the high segment or agree in the low one. So each distinct fingerprint enters one table under its high segment
and one under its low segment; a search enumerates the Hamming ball of radius one around its high segment, and takes its
low segment as it is, fetches what the tables hold there and verifies the complete distance. Of two neighbouring segments
one has a 0 where the other has a 1, so only flips from 0 to 1 need be tried.

A table entry that holds more than ``BUCKET`` fingerprints (large groups of near copies) is not paired. All fingerprints
that would meet there are linked by balls over the whole fingerprint instead: two of them differ in at most two bits
exactly if their balls of radius one have a common member, and such a member has 65 neighbours at most. That costs 65
rows for a fingerprint, however large the group, and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencegraph.functions.lineage import cut
from fencegraph.llm.common import small_batches, tasks
from fencegraph.llm.components import connected

SEED, BUCKET = 42, 64
_CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """Of the words of ``text`` (A-Z lower-cased, ASCII white space between): unsigned, 0 where there is no word."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(shingles), _CHUNK):
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles[lo : lo + _CHUNK]), np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(shingles), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str, out: str = "fingerprint") -> DataFrame:
    """``docs`` without its text, with the fingerprint as a (signed) long. Null and empty texts get 0."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(x.as_py() or b"") for x in batch.column(0)), np.uint64, batch.num_rows)
            rest = batch.select(range(1, batch.num_columns))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(values.view(np.int64))], names=[*rest.schema.names, "__fp"])

    small_batches(docs.sparkSession)
    kept = docs.drop(text, out)
    plain = docs.select(F.col(text).cast("binary").alias("__bytes"), *[docs[c].alias(f"c{i}") for i, c in enumerate(kept.columns)])
    types = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema)] + ["__fp long"])
    return plain.mapInArrow(digest, types).toDF(*kept.columns, out)


def _high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _low(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _raised(value: Column, bits: int) -> Column:
    """``value`` and all values that have one more bit set, among the lowest ``bits``."""
    each = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(bits)])
    return F.concat(F.array(value), F.transform(F.filter(each, lambda m: value.bitwiseAND(m) == 0), lambda m: value.bitwiseOR(m)))


def links(distinct: DataFrame, fp: str) -> DataFrame:
    """Links (a, b), enough to connect all fingerprints that differ in 1 or 2 bits; every link is such a pair."""
    n = tasks(distinct.sparkSession)
    rows = cut(distinct.select(F.col(fp).alias("fp")).repartition(n, "fp"), "fingerprints")
    entries = rows.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), _high(F.col("fp")).alias("key")), F.struct(F.lit(1).alias("seg"), _low(F.col("fp")).alias("key")))).alias("e")).select("fp", "e.*")
    probes = rows.select("fp", F.lit(0).alias("seg"), F.explode(_raised(_high(F.col("fp")), 32)).alias("key")).unionAll(rows.select("fp", F.lit(1).alias("seg"), _low(F.col("fp")).alias("key")))
    full = cut(entries.groupBy("seg", "key").count().where(F.col("count") > BUCKET).select("seg", "key"), "full")
    buckets = entries.join(full, ["seg", "key"], "left_anti").groupBy("seg", "key").agg(F.collect_list("fp").alias("members"))
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    paired = (
        probes.join(buckets, ["seg", "key"]).select(F.col("fp").alias("a"), F.filter("members", lambda m: F.bit_count(m.bitwiseXOR(F.col("fp"))).between(1, 2)).alias("near"))
        .where(F.size("near") > 0).select("a", F.explode("near").alias("b")).where(differ.between(1, 2))
    )
    meeting = probes.join(full, ["seg", "key"], "left_semi").select("fp").unionAll(entries.join(full, ["seg", "key"], "left_semi").select("fp")).distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    balls = meeting.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("ball"))
    common = balls.groupBy("ball").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    stars = common.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a != b")
    return paired.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionAll(stars).distinct()


def groups(docs: DataFrame, doc_id: str, text: str, *also: Column) -> DataFrame:
    """A row per document: ``doc_id``, ``fp`` (signed long), ``component_id`` (smallest id reachable over links of at most
    two differing bits, its own included), and the columns ``also``.

    Equal fingerprints are one node, so copies are never expanded into pairs. Documents without words have fingerprint 0 and
    are linked like any other. Repeated ids stay as rows. Null ids are answered, but are no component id unless all are null.
    """
    prints = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *also), "text", "fp"), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    parts = connected(links(nodes, "fp"), "a", "b")
    named = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("part"))
    named = cut(named, "parts")
    ids = named.groupBy("part").agg(F.min("first").alias("component_id"))
    of_print = named.join(ids, "part").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id", *prints.drop("doc_id", "fp").columns)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
