"""Shards of bounded size by extendible hashing, in DataFrame operations alone.

A row's hash code has 60 bits. The directory is addressed by a prefix of them; a bucket whose rows exceed the byte limit is
split on the next bit, and all others keep their shorter prefix. Rather than one bit a round, a round sums the bytes of the
next ``STRIDE`` bits of all buckets still open and rolls those few sums up to every shorter prefix, so a bucket finds its
depth at once; only buckets that are too large even then enter another round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencegraph.functions.lineage import cut

BITS, STRIDE = 60, 10


def hash_code(*keys: Column) -> Column:
    """60 bits of the md5 of the keys as text. Further keys tell rows of an equal first key apart, so that a hot key splits too."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(code: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits of a code as a number."""
    return F.call_function("shiftright", code, F.lit(BITS) - depth)


def directory(rows: DataFrame, code: str, size: str, max_bytes: int) -> DataFrame:
    """(depth, bits, shard_bytes, shard_rows): the final buckets of all rows.

    Each holds ``max_bytes`` at most, but for rows of one and the same code, which no bit can part: they stay together at
    full depth (a single row may also exceed the limit by itself). Null sizes count as 0. No rows, no shards. Rows are
    summed in the map tasks before anything is shuffled, and the sums of a round are read, not the rows.
    """
    live = rows.select(F.col(code).alias("h"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("b"))
    done: list[DataFrame] = []
    for lowest in range(0, BITS + 1, STRIDE + 1):
        deepest = min(lowest + STRIDE, BITS)
        fine = cut(live.groupBy(prefix(F.col("h"), deepest).alias("p")).agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")), "buckets")
        levels = reduce(
            DataFrame.unionAll,
            [fine.groupBy(F.lit(d).alias("depth"), F.call_function("shiftright", "p", F.lit(deepest - d)).alias("bits")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows")) for d in range(lowest, deepest + 1)],
        )
        levels = cut(levels, "levels")
        fits = (F.col("shard_bytes") <= max_bytes) | (F.col("depth") == BITS)
        # a bucket is final if it fits and the bucket it comes from does not
        above = levels.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("bits").alias("from"))
        inner = levels.where(fits).withColumn("from", F.call_function("shiftright", "bits", F.lit(1)))
        first = inner.where(F.col("depth") == lowest).drop("from")
        done.append(first.unionAll(inner.where(F.col("depth") > lowest).join(above, ["depth", "from"], "left_semi").select(*first.columns)))
        open_ = levels.where((F.col("depth") == deepest) & ~fits).select(F.col("bits").alias("p"))
        if deepest == BITS or not open_.take(1):
            break
        live = live.withColumn("p", prefix(F.col("h"), deepest)).join(open_, "p", "left_semi").select("h", "b")
    return cut(reduce(DataFrame.unionAll, done), "directory")


def assign(docs: DataFrame, keys: list[str], size: Column, max_bytes: int) -> DataFrame:
    """All columns of ``docs`` with ``shard`` (the prefix in binary digits, ``*`` for no bit), ``shard_depth``, ``shard_bytes``
    and ``shard_rows``; columns of these names are replaced. Null keys hash like empty text; repeated rows share a shard."""
    kept = docs.drop("shard", "shard_depth", "shard_bytes", "shard_rows")
    coded = kept.withColumn("__h", hash_code(*[kept[k] for k in keys])).withColumn("__b", size)
    shards = directory(coded.select("__h", "__b"), "__h", "__b", max_bytes)
    depths = [r[0] for r in shards.select("depth").distinct().collect()]  # 61 values at most
    # each depth present is tried by a join on that many bits; buckets part the codes, so exactly one answers
    options = F.array(*[F.struct(F.lit(d).alias("d"), prefix(F.col("__h"), d).alias("p")) for d in sorted(depths)]) if depths else F.array(F.struct(F.lit(0).alias("d"), F.lit(0).cast("long").alias("p")))
    tried = coded.drop("__b").withColumn("__o", F.explode(options))
    found = tried.join(shards, (F.col("__o.d") == shards["depth"]) & (F.col("__o.p") == shards["bits"]))
    name = F.when(F.col("depth") == 0, F.lit("*")).otherwise(F.lpad(F.conv(F.col("bits").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    return found.select(*[kept[c] for c in kept.columns], name.alias("shard"), F.col("depth").alias("shard_depth"), "shard_bytes", "shard_rows")


def write(assigned: DataFrame, path: str) -> None:
    """A folder per shard under ``path``. Rows of a shard meet in one task, which its byte limit bounds."""
    assigned.repartition("shard").write.partitionBy("shard").parquet(path)
