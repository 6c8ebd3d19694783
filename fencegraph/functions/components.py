"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fencegraph.functions.lineage import cut


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges as (node, component): the smallest node reachable, for every node that has an edge to another.

    Null ends and loops are ignored; repeated edges count once. Every round is written to the shared folder, so a lost
    executor costs one round at most. Minima combine in the map tasks before anything is shuffled; only the joins see a
    hub's rows together, and adaptive execution splits those.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("m")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    before = None
    while True:
        count = _state(now)
        if count == before:
            break
        before = count
        both = now.select(F.col("u").alias("x"), F.col("m").alias("y")).unionAll(now.select(F.col("m").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("low"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("low").alias("m")).where("u != m").distinct()
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("m").alias("low"))
        small = large.join(low, F.col("u") == F.col("x")).select(F.when(F.col("m") == F.col("low"), F.col("u")).otherwise(F.col("m")).alias("u"), F.col("low").alias("m"))
        now = cut(small.where("u != m").distinct(), "edges")
    roots = now.select("m").distinct().select(F.col("m").alias("node"), F.col("m").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("m").alias("component")).unionAll(roots)


def _state(edges: DataFrame) -> tuple:
    """What a round that changes nothing leaves as it was."""
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "m").cast("decimal(38,0)"))).first()
    return tuple(r)
