"""Streams over the driver tables, and the model seams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fencegraph.catalog.base import DOCS, ENTITY_CTES, TOKENS, query
from fencegraph.catalog.entity_queries import chapters, linked
from fencegraph.catalog.identity_queries import cite
from fencegraph.catalog.prep_queries import stored_chapters
from fencegraph.catalog.registry import Registry
from fencegraph.catalog.relation_queries import ACC, PAIRS
from fencegraph.functions.lineage import scratch
from fencegraph.operators import identity as T3
from fencegraph.operators import search as S
from fencegraph.plans import build
from fencegraph.schema import TABLES
from fencegraph.sources import adaptors as A
from fencegraph.sources.store import GraphStore
from fencegraph.streaming import arrivals as ST

R = Registry()
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, d: str) -> DataFrame:
    return ST.file_stream(spark, d, EVENTS, "events.parquet")


def finished(spark: SparkSession, stream: DataFrame) -> DataFrame:
    out = scratch(spark, "stream")
    ST.drain(ST.to_parquet(stream, out, scratch(spark, "offsets")))
    return spark.read.schema(stream.schema).parquet(out)


@R.add("s1_streamed_chapters", query([DOCS], "SELECT work_id, ordinal, sha256(clean_text) AS content_hash FROM ch UNION ALL SELECT work_id, -1, sha256(clean_text) FROM ch WHERE ordinal = 1"))
def streamed_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Old chapters arrive first, the current ones later; the table ends up as a batch upsert leaves it."""
    inbox, offsets = scratch(spark, "inbox"), scratch(spark, "offsets")
    store = GraphStore(spark, scratch(spark, "store"), 8)
    store.write("chapters", spark.createDataFrame([], TABLES["chapters"]))
    for arriving in (stored_chapters(spark, d), chapters(spark, d)):
        arriving.withColumn("src_pos", F.lit(0)).write.mode("append").parquet(inbox)
        stream = ST.file_stream(spark, inbox, TABLES["chapters"] + ", src_pos int")
        ST.drain(ST.upsert_chapters(stream, store, offsets))
    return store.rows("chapters").select("work_id", "ordinal", "content_hash")


@R.add(
    "s2_running_entities",
    "SELECT user_id AS work_id, event_type AS entity, CAST(min(day(ts)) AS INTEGER) AS first_seen_chapter, count(*) AS mentions FROM events GROUP BY ALL",
)
def running_entities(spark: SparkSession, d: str) -> DataFrame:
    """Late days arrive first, so earlier days lower what was emitted."""
    e = A.table(spark, d, "events").select(F.col("user_id").alias("work_id"), F.col("event_type").alias("entity"), F.dayofmonth("ts").alias("chapter"))
    inbox, offsets, store = scratch(spark, "inbox"), scratch(spark, "offsets"), GraphStore(spark, scratch(spark, "store"), 8)
    for part in (e.filter("chapter > 15"), e.filter("chapter <= 15")):
        part.write.mode("append").parquet(inbox)
        ST.drain(ST.running_entities(ST.file_stream(spark, inbox, "work_id long, entity string, chapter int"), store, offsets))
    return store.rows("running_entities")


def streamed_mentions(spark: SparkSession, d: str) -> GraphStore:
    """Linked mentions as a stream of three deliveries: of each chapter every other mention, with an older version of every third
    chapter beside it; then the others, and some for the second time; then every fourth chapter whole in a newer version, which
    at first had come with its offsets shifted, together with what an outdated version says."""
    m = linked(spark, d).select("work_id", "chapter_ordinal", F.lit(1).cast("long").alias("version"), "mention_id", "node_id", "node_type", "char_start", "char_end")
    old = m.filter("chapter_ordinal % 3 = 0").withColumn("version", F.lit(0).cast("long")).withColumn("char_start", F.col("char_start") * 2).withColumn("char_end", F.col("char_end") * 2)
    again = m.filter("chapter_ordinal % 4 = 0")
    wrong = again.withColumn("node_id", F.col("node_id") + F.col("mention_id") % 7).withColumn("char_start", F.col("char_start") + 5)
    right = again.withColumn("version", F.lit(2).cast("long"))
    plain = m.filter("chapter_ordinal % 4 <> 0")
    inbox, offsets, store = scratch(spark, "inbox"), scratch(spark, "offsets"), GraphStore(spark, scratch(spark, "store"), 8)
    for part in (plain.filter("mention_id % 2 = 0").unionByName(old).unionByName(wrong), plain.filter("mention_id % 2 = 1 OR mention_id % 5 = 0"), right.unionByName(old)):
        part.write.mode("append").parquet(inbox)
        ST.drain(ST.chapter_statistics(ST.file_stream(spark, inbox, ST.ARRIVING), store, offsets))
    return store


@R.add("s3_streamed_pairs", query([*ENTITY_CTES, PAIRS, ACC], "SELECT work_id, lo, hi, cooccurrences, chapter FROM ac"))
def streamed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Chapters in parts, delivered twice and replaced: the pairs are those of one batch."""
    return ST.pair_totals(streamed_mentions(spark, d).rows("chapter_pairs"))


@R.add("s2_retracted_entities", query(ENTITY_CTES, "SELECT work_id, node_id, count(*) AS mentions, min(chapter_ordinal) AS first_seen_chapter FROM lm WHERE node_id IS NOT NULL GROUP BY ALL"))
def retracted_entities(spark: SparkSession, d: str) -> DataFrame:
    """First chapters and counts after chapters were replaced; what the replaced versions had counted is taken back."""
    return ST.entity_totals(streamed_mentions(spark, d).rows("chapter_entities"))


@R.add("s4_without_repeats", "SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(DISTINCT 1) AS deliveries FROM events GROUP BY ALL")
def without_repeats(spark: SparkSession, d: str) -> DataFrame:
    """One delivery per user, type and day; each event is delivered twice."""
    e = events(spark, d).select("ts", "user_id", "event_type", F.to_date("ts").alias("day"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    got = finished(spark, ST.without_repeats(e, ["user_id", "event_type", "day"], delay="1 day"))
    return got.groupBy("user_id", "event_type", "day").agg(F.count(F.lit(1)).alias("deliveries"))


_closed = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@R.add(
    "s5_tumbling_activity",
    f"""SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS start_s, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL
    HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= {_closed}""",
)
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    got = finished(spark, ST.activity(events(spark, d), F.window("ts", "1 hour"), ["event_type"]))
    return got.select(F.unix_timestamp("start").alias("start_s"), "event_type", "events", F.round("total", 4).alias("total"))


@R.add(
    "s5_sliding_activity",
    f"""WITH x AS (SELECT date_trunc('hour', ts) - o * INTERVAL 1 HOUR AS start, value FROM events, (VALUES (0), (1)) t(o))
    SELECT epoch_us(start) // 1000000 AS start_s, count(*) AS events, round(sum(value), 4) AS total FROM x GROUP BY start HAVING start + INTERVAL 2 HOUR <= {_closed}""",
)
def sliding(spark: SparkSession, d: str) -> DataFrame:
    got = finished(spark, ST.activity(events(spark, d), F.window("ts", "2 hours", "1 hour"), []))
    return got.select(F.unix_timestamp("start").alias("start_s"), "events", F.round("total", 4).alias("total"))


@R.add(
    "s5_session_activity",
    f"""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 HOUR THEN 1 ELSE 0 END AS brk FROM events),
    s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY user_id, no HAVING max(ts) + INTERVAL 3 HOUR <= {_closed}""",
)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    got = finished(spark, ST.activity(events(spark, d), F.session_window("ts", "3 hours"), ["user_id"]))
    return got.select("user_id", F.unix_micros("start").alias("start_us"), "events", F.round("total", 4).alias("total"))


# ------------------------------------------------------------------ seams


def capitalised_words(chunks: DataFrame) -> DataFrame:
    """A tagger written as a pandas function, as a model runtime would be."""

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word = re.compile(r"(?:(?<= )|(?<=\A))[A-Z][a-z]{3,}(?= |\Z)")
        for b in batches:
            rows = [
                (w, c, o, m.group(), "Character" if len(m.group()) % 2 else "Place", None, m.start(), m.end(), 0.9)
                for w, c, o, t in zip(b["work_id"], b["chapter_ordinal"], b["ordinal"], b["text"], strict=True)
                for m in word.finditer(t)
            ]
            yield pd.DataFrame(rows, columns=["work_id", "chapter_ordinal", "chunk_ordinal", "surface", "label", "subtype", "char_start", "char_end", "score"])

    schema = "work_id long, chapter_ordinal int, chunk_ordinal int, surface string, label string, subtype string, char_start int, char_end int, score double"
    return chunks.select("work_id", "chapter_ordinal", "ordinal", "text").mapInPandas(tag, schema)


def whole_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chapters(spark, d).select("work_id", F.col("ordinal").alias("chapter_ordinal"), F.lit(0).alias("ordinal"), F.lit(0).alias("char_start"), F.length("clean_text").alias("char_end"), F.col("clean_text").alias("text"))


@R.add(
    "u1_custom_tagger",
    query([DOCS, TOKENS], """SELECT work_id, ordinal AS chapter_ordinal, tok AS surface, CASE WHEN length(tok) % 2 = 1 THEN 'Character' ELSE 'Place' END AS type, start AS char_start FROM tks WHERE regexp_matches(tok, '^[A-Z][a-z]{3,}$')"""),
)
def custom_tagger(spark: SparkSession, d: str) -> DataFrame:
    k = whole_chunks(spark, d)
    _, m = build.extract(chapters(spark, d), k, capitalised_words)
    return m.select("work_id", "chapter_ordinal", "surface", "type", "char_start")


@R.add(
    "u2_custom_relation_model",
    query([*ENTITY_CTES, PAIRS], """SELECT p.work_id, 'Ally' AS relation, count(*) AS spans FROM pr p JOIN ch c ON c.work_id = p.work_id AND c.ordinal = p.chapter_ordinal
    WHERE p.b_s >= p.a_e AND contains(lower(substr(c.clean_text, p.a_e + 1, p.b_s - p.a_e)), ',') GROUP BY ALL"""),
)
def custom_relations(spark: SparkSession, d: str) -> DataFrame:
    """A relation model with one phrase: a comma between two names makes allies."""
    from fencegraph.operators import social

    model: build.RelationModel = lambda chunks, mentions: social.cue_spans(mentions, chunks, {",": "Ally"})
    k = whole_chunks(spark, d)
    return model(k, build.chunk_positions(linked(spark, d), k)).groupBy("work_id", "relation").agg(F.count(F.lit(1)).alias("spans"))


@R.add(
    "u3_custom_identity_model",
    f"""WITH c AS (SELECT conv_id, {cite("array_to_string(string_split(text, ' ')[1:4], ' ')")} AS clue FROM conversations)
    SELECT conv_id AS work_id, count(*) AS verdicts, count(*) FILTER (length(clue) >= 8) AS valid FROM c GROUP BY ALL""",
)
def custom_identity(spark: SparkSession, d: str) -> DataFrame:
    """A model that answers every (pair, window) with the opening words of the chapter read last."""
    ch = A.conv_chapters(spark, d)
    asked = ch.filter("ordinal = 1").select("work_id", F.split("clean_text", " ")[0].alias("name_a"), F.element_at(F.split("clean_text", " "), -1).alias("name_b")).join(T3.reading_windows(ch), "work_id")

    def model(pairs: DataFrame) -> DataFrame:
        opening = ch.select("work_id", F.col("ordinal").alias("k"), F.array_join(F.slice(F.split("clean_text", " "), 1, 4), " ").alias("clue"))
        return pairs.join(opening, ["work_id", "k"]).select("work_id", "name_a", "name_b", "k", F.lit(True).alias("same"), F.lit('"ALIAS"').alias("relation_raw"), "clue")

    v = T3.judge(model(asked), ch)
    return v.groupBy("work_id").agg(F.count(F.lit(1)).alias("verdicts"), F.count_if("valid").alias("valid"))


@R.add(
    "u4_custom_embedder",
    query([DOCS], """SELECT work_id, CAST(ordinal AS BIGINT) * 2147483648 AS chunk_id, length(clean_text) - length(replace(clean_text, 'a', '')) AS a, length(clean_text) - length(replace(clean_text, 'e', '')) AS e FROM ch"""),
)
def custom_embedder(spark: SparkSession, d: str) -> DataFrame:
    """An embedder as a plain column expression: letter counts."""
    counts = lambda t: F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(c)))).cast("double") for c in "ae"])
    i = S.index_chunks(whole_chunks(spark, d), counts)
    return i.select("work_id", "chunk_id", F.col("embedding")[0].cast("long").alias("a"), F.col("embedding")[1].cast("long").alias("e"))


QUERIES, ORACLES = R.queries, R.oracles
