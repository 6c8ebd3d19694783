"""Numbering and running totals that never put a whole key into one task.

A plain ``row_number() OVER (PARTITION BY work ...)`` sends every row of a work to
one task. Where one work may hold a third of the data that does not scale, so rows
are numbered inside bounded buckets and shifted by the size of the buckets before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def running_total(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str, *, inclusive: bool = True, block: int = BLOCK
) -> DataFrame:
    """Running sum of ``value`` along the integer ``pos`` (unique per key), in two levels.

    Blocks of positions are summed first; the window over block sums sees one row per
    ``block`` positions, the window inside a block at most ``block`` rows.
    """
    keys = list(keys)
    blk = "__blk"
    rows = df.withColumn(blk, F.floor(F.col(pos) / block))
    sums = rows.groupBy(*keys, blk).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, blk, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*keys, blk).orderBy(pos).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1
    )
    local = rows.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(offsets, [*keys, blk]).withColumn(out, F.col("__in") + F.col("__off")).drop(blk, "__in", "__off")


def number_rows(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], out: str, *, first: int = 1
) -> DataFrame:
    """Number rows per key by ``(bucket, *order)``; ``bucket`` is an integer that bounds the rows sorted together."""
    keys = list(keys)
    rows = df.withColumn("__bkt", bucket.cast("long"))
    sizes = rows.groupBy(*keys, "__bkt").agg(F.count(F.lit(1)).alias("__n"))
    offsets = running_total(sizes, keys, "__bkt", "__n", "__before", inclusive=False).drop("__n")
    w = Window.partitionBy(*keys, "__bkt").orderBy(*order)
    return (
        rows.withColumn("__rn", F.row_number().over(w))
        .join(offsets, [*keys, "__bkt"])
        .withColumn(out, F.col("__rn") + F.col("__before") + F.lit(first - 1))
        .drop("__bkt", "__rn", "__before")
    )


def number_lists(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], out: str, mark: Column, *, among: DataFrame | None = None, long: int = 1 << 16, share: int = 64, first: int = 1
) -> DataFrame:
    """As ``number_rows``, for keys most of which have few rows: those are sorted whole, with no sizes of buckets to shuffle, and only the
    long lists, of about ``long`` rows or more, bucket by bucket.

    Which lists are long is told from the rows whose hash of ``mark`` (different in each row of a list) falls into one of ``share`` shares; the numbers are the same
    for any answer. ``among`` are the rows before what was joined to them, if counting those costs less.
    """
    from fencegraph.functions.lineage import cut

    keys, among = list(keys), df if among is None else among
    some = among.filter(F.pmod(F.xxhash64(mark), F.lit(share)) == 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    far = cut(some.filter(F.col("__n") * share * 2 >= long).select(*keys), "long")
    sizes = among.join(far, keys, "left_semi").groupBy(*keys, bucket.cast("long").alias("__bkt")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = cut(running_total(sizes, keys, "__bkt", "__n", "__before", inclusive=False).drop("__n"), "offsets")
    rows = df.join(far.withColumn("__long", F.lit(True)), keys, "left").withColumn("__bkt", F.when(F.col("__long"), bucket.cast("long"))).drop("__long")
    w = Window.partitionBy(*keys, "__bkt").orderBy(bucket, *order)
    return (
        rows.withColumn("__rn", F.row_number().over(w))
        .join(offsets, [*keys, "__bkt"], "left")
        .withColumn(out, F.col("__rn") + F.coalesce("__before", F.lit(0)) + F.lit(first - 1))
        .drop("__bkt", "__rn", "__before")
    )


def number_by_position(df: DataFrame, keys: Sequence[str], pos: str, out: str, *, first: int = 1) -> DataFrame:
    """Number rows per key by an integer column that is unique within the key."""
    return number_rows(df, keys, F.floor(F.col(pos) / BLOCK), [F.col(pos)], out, first=first)


def number_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, *, first: int = 1) -> DataFrame:
    """Number rows per key by columns of any type, using a range partitioning over ``(keys, order)``.

    The range partitioning splits a hot key over many tasks. It is cut through a
    checkpoint, so both uses of the partition number below see the same placement.
    """
    from fencegraph.functions.lineage import cut

    keys, order = list(keys), list(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = cut(df.repartitionByRange(parts, *keys, *order).withColumn("__pid", F.spark_partition_id()))
    return number_rows(placed, keys, F.col("__pid"), [F.col(c) for c in order], out, first=first).drop("__pid")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark limits each key inside the map tasks first (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)
