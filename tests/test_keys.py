import pytest
from pyspark.sql import functions as F

from fencegraph.functions import keys
from fencegraph.operators import entities as E
from fencegraph.operators import search as S

SPANS = "work_id long, chapter_ordinal int, surface string, type string, char_start int, char_end int"


def test_many_mentions_of_late_works(spark):
    """Ids neither overflow nor meet: works numbered beyond 10**7, a chapter of over a million mentions."""
    n = 1_100_000
    spans = spark.range(n).select(F.lit(10**7 + 1).alias("work_id"), F.lit(3).alias("chapter_ordinal"), F.lit("Mara").alias("surface"), F.lit("Character").alias("type"), F.col("id").cast("int").alias("char_start"), (F.col("id") + 1).cast("int").alias("char_end"))
    more = spark.createDataFrame([(10**7 + 1, 4, "Mara", "Character", 0, 4), (10**15, 2**31 - 1, "Orsa", "Character", 0, 4), (10**15, 1, "Orsa", "Character", 9, 13)], SPANS)
    m = E.number_mentions(spans.unionByName(more))
    assert m.select("work_id", "mention_id").distinct().count() == n + 3
    last = m.filter(f"work_id = {10**7 + 1}").orderBy(F.desc("mention_id")).first()
    assert (last.chapter_ordinal, last.ordinal) == (4, 0)


def test_ids_have_an_end_that_is_told(spark):
    df = spark.createDataFrame([(10**7, 5), (2 * 10**8, keys.NODES - 1)], "w long, no long")
    assert [r[0] for r in df.select(keys.node_id(F.col("w"), F.col("no"))).collect()] == [10**7 * keys.NODES + 5, 2 * 10**8 * keys.NODES + keys.NODES - 1]
    assert df.select(keys.edge_id(F.col("w"), 3, F.col("no")).alias("e")).distinct().count() == 2
    with pytest.raises(Exception, match="needs more than"):
        df.select(keys.node_id(F.col("w"), F.col("no") + 1)).collect()


def test_chunks_of_late_works_are_found_and_cited(spark):
    """Equal chunk ids in two works: hits, replacement and citations stay with their work."""
    works = (10**9, 10**9 + 1)
    chunks = spark.createDataFrame([(w, c, 0, 0, 9, f"word{w} in chapter {c}.") for w in works for c in range(1, 40)], "work_id long, chapter_ordinal int, ordinal int, char_start int, char_end int, text string")
    index = S.index_chunks(chunks)
    q = spark.createDataFrame([(1, works[0], 39, f"word{works[0]}"), (2, works[1], 20, f"word{works[1]}")], "q_id long, work_id long, n int, query string")
    hits = S.top_k(q.withColumn("embedding", S.hashed_words(F.col("query"))), index, 3)
    assert hits.count() == 6
    said = {r.q_id: r.answer for r in S.compose_answers(q, hits, index).collect()}
    assert f"word{works[0]}" in said[1] and f"word{works[1]}" in said[2] and str(works[1]) not in said[1]
    fresh = index.filter(f"work_id = {works[0]} AND chapter_ordinal = 1").withColumn("text", F.lit("new"))
    assert S.upsert_chunks(index, fresh).groupBy("work_id").count().filter("count = 39").count() == 2
