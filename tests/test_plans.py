"""The plans of the hot operators: what is pushed down, and what must never appear."""

from fencegraph.functions.lineage import cut
from fencegraph.functions.ranking import top_rows
from fencegraph.operators import fence, social
from fencegraph.operators import relations as T1
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_fence_is_pushed_to_the_scan(spark):
    e = cut(spark.range(100).select(F.col("id").alias("edge_id"), F.col("id").cast("int").alias("effective_reveal"), F.lit("x").alias("evidence")))
    p = plan(fence.visible_edges(e, e, 7).select("edge_id"))
    assert "LessThanOrEqual(effective_reveal,7)" in p and "evidence" not in p.split("ReadSchema")[1].split("\n")[0]
    nodes = cut(spark.range(10).select(F.col("id").alias("node_id"), F.col("id").cast("int").alias("revealed_chapter")))
    assert "LessThanOrEqual(revealed_chapter,3)" in plan(fence.visible_nodes(nodes, 3))


def test_top_k_is_limited_before_the_shuffle(spark):
    p = plan(top_rows(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], [F.desc("id")], 2))
    assert "WindowGroupLimit" in p


def test_no_nested_loops(spark):
    m = cut(spark.range(50).select(
        F.lit(1).alias("work_id"), F.lit(1).alias("chapter_ordinal"), F.lit(0).alias("chunk_ordinal"), F.col("id").alias("mention_id"), (F.col("id") % 5).alias("node_id"),
        F.lit("Character").alias("node_type"), (F.col("id") * 9).cast("int").alias("char_start"), (F.col("id") * 9 + 4).cast("int").alias("char_end"), F.lit("n").alias("surface"),
    ))
    chunks = cut(spark.range(1).select(F.lit(1).alias("work_id"), F.lit(1).alias("chapter_ordinal"), F.lit(0).alias("ordinal"), F.lit("x" * 500).alias("text")))
    for df in (T1.accumulate_pairs(T1.band_pairs(m)), social.cue_spans(m, chunks)):
        p = plan(df)
        assert "CartesianProduct" not in p and "NestedLoop" not in p
