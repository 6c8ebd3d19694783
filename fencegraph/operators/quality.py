"""Data quality: vocabulary, keys, references, offsets, stamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fencegraph import vocab


def node_vocabulary(nodes: DataFrame) -> DataFrame:
    """Rows whose type, subtype or method is outside the vocabulary: (work_id, id, problem)."""
    pairs = [f"{t}/{s}" for t, subs in vocab.SUBTYPES.items() for s in subs]
    checks = F.array_compact(
        F.array(
            F.when(~F.col("type").isin(vocab.NODE_TYPES), F.lit("type")),
            F.when(F.col("subtype").isNotNull() & ~F.concat_ws("/", "type", "subtype").isin(pairs), F.lit("subtype")),
            F.when(~F.col("method").isin(vocab.METHODS), F.lit("method")),
        )
    )
    return nodes.select("work_id", F.col("node_id").alias("id"), F.explode(checks).alias("problem"))


def edge_vocabulary(edges: DataFrame) -> DataFrame:
    tier = vocab.relation_tier(F.col("relation"))
    checks = F.array_compact(
        F.array(
            F.when(tier.isNull(), F.lit("relation")),
            F.when(tier != F.col("tier"), F.lit("tier")),
            F.when(~F.col("method").isin(vocab.METHODS), F.lit("method")),
        )
    )
    return edges.select("work_id", F.col("edge_id").alias("id"), F.explode(checks).alias("problem"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def dangling(df: DataFrame, column: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference has no target."""
    t = targets.select(F.col(key).alias("__k"))
    return df.filter(F.col(column).isNotNull()).join(t, F.col(column) == F.col("__k"), "left_anti")


def offset_violations(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chunks whose text is not the slice of their chapter."""
    ch = chapters.select("work_id", F.col("ordinal").alias("chapter_ordinal"), "clean_text")
    cutout = F.expr("substring(clean_text, char_start + 1, char_end - char_start)")
    return chunks.join(ch, ["work_id", "chapter_ordinal"], "left").filter(~cutout.eqNullSafe(F.col("text")))


def merge_stamps(before: DataFrame, after: DataFrame, canon: DataFrame) -> DataFrame:
    """Per work: edges after a merge, and those one of whose stamps (reveal, first seen) is not the minimum of their sources."""
    to = canon.select(F.col("node_id").alias("__j"), F.col("pov_id").alias("__p"))
    m = before.join(to.select(F.col("__j").alias("source_id"), F.col("__p").alias("__s")), "source_id", "left")
    m = m.join(to.select(F.col("__j").alias("target_id"), F.col("__p").alias("__t")), "target_id", "left")
    key = ["work_id", "source_id", "target_id", "relation", "tier"]
    low = m.withColumn("source_id", F.coalesce("__s", "source_id")).withColumn("target_id", F.coalesce("__t", "target_id")).groupBy(*key).agg(
        F.min("revealed_chapter").alias("lowest"), F.min("first_seen_chapter").alias("__first")
    )
    return after.join(low, key, "left").groupBy("work_id").agg(
        F.count(F.lit(1)).alias("merged_edges"), F.count_if(~F.col("lowest").eqNullSafe(F.col("revealed_chapter")) | ~F.col("__first").eqNullSafe(F.col("first_seen_chapter"))).alias("violations")
    )


def violation_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """One row per named check with its number of violations."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = row if out is None else out.unionByName(row)
    return out

