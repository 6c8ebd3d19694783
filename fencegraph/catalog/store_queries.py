"""Sources, sinks and table maintenance over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fencegraph import config
from fencegraph.catalog.base import DOCS, ENTITY_CTES, STAR_CTES, STAR_PROPS, query, snippet
from fencegraph.catalog.entity_queries import chapters, doc_nodes, linked
from fencegraph.catalog.fence_queries import star_edges, star_nodes, star_properties
from fencegraph.catalog.prep_queries import CHUNKS
from fencegraph.catalog.registry import Registry
from fencegraph.functions import text as X
from fencegraph.functions.lineage import scratch
from fencegraph.functions.ranking import number_by_range
from fencegraph.operators import entities as E
from fencegraph.operators import prep as P
from fencegraph.plans import build
from fencegraph.sources import adaptors as A
from fencegraph.sources import files
from fencegraph.sources.store import GraphStore, get_or_create_works

R = Registry()


def new_store(spark: SparkSession, buckets: int = 8) -> GraphStore:
    return GraphStore(spark, scratch(spark, "store"), buckets)


def star_store(spark: SparkSession, d: str) -> GraphStore:
    s = new_store(spark)
    s.write("nodes", star_nodes(spark, d))
    s.write("edges", star_edges(spark, d))
    s.write("node_properties", star_properties(spark, d))
    return s


# ------------------------------------------------------------------ sources


@R.add(
    "a1_chapter_directory",
    """WITH s AS (SELECT item_id, text, CASE WHEN item_id % 5 = 0 THEN 'ch-' || translate(CAST(item_id AS VARCHAR), '0123456789', 'abcdefghij') ELSE 'vol' || item_id || '-part2' END AS stem FROM benchmark),
    o AS (SELECT *, row_number() OVER (ORDER BY stem) - 1 AS pos FROM s)
    SELECT CAST(CASE WHEN item_id % 5 = 0 THEN pos + 3 ELSE item_id END AS INTEGER) AS ordinal, CASE WHEN item_id % 2 = 0 THEN 'Chapter 9: ' || item_id ELSE stem END AS title, md5(text || chr(10)) AS text_hash FROM o""",
)
def chapter_directory(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark passage as a text file of its own, read back as a chapter directory."""
    b = A.table(spark, d, "benchmark")
    letters = F.translate(F.col("item_id").cast("string"), "0123456789", "abcdefghij")
    stem = F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("ch-"), letters)).otherwise(F.concat(F.lit("vol"), F.col("item_id").cast("string"), F.lit("-part2")))
    head = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("\nChapter 9: "), F.col("item_id").cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    path = scratch(spark, "chapters")
    b.select(stem.alias("stem"), F.concat(head, "text").alias("value")).repartition("stem").write.partitionBy("stem").text(path)
    texts = files.read_texts(spark, path, stem=r"stem=([^/]+)/")
    c = files.chapter_directory(texts, F.lit(1).cast("long"), P.HEADING, first_number=3)
    return c.select("ordinal", "title", F.md5(F.col("raw_text").cast("binary")).alias("text_hash"))


@R.add("a2_undecodable_bytes", "SELECT doc_id, md5(regexp_replace(text, '[^\\x00-\\x7f]', chr(65533), 'g')) AS text_hash FROM documents")
def undecodable(spark: SparkSession, d: str) -> DataFrame:
    """Texts stored in another encoding: every byte that is not UTF-8 is replaced."""
    t = A.spread(A.table(spark, d, "documents").select("doc_id", "text"))
    return t.select("doc_id", F.md5(X.decode_utf8(F.encode("text", "ISO-8859-1")).cast("binary")).alias("text_hash"))


KNOB_SQL = """
kb AS (SELECT DISTINCT work_id, CASE WHEN work_id % 3 = 0 THEN 300 + work_id ELSE 1500 END AS max_chars, CASE WHEN work_id % 3 = 1 THEN 0 ELSE 1 END AS overlap_sentences,
              CASE WHEN work_id % 3 = 1 THEN 0.6 ELSE 0.4 END AS threshold FROM ch)"""


@R.add("a3_work_knobs", query([DOCS, KNOB_SQL], "SELECT work_id, CAST(max_chars AS INTEGER) AS max_chars, overlap_sentences, CAST(threshold AS DOUBLE) AS threshold, 'auto' AS chapter_mode FROM kb"))
def work_knobs(spark: SparkSession, d: str) -> DataFrame:
    """Knobs as JSON documents: a third of the works sets one, a third two others, a third has none."""
    w = chapters(spark, d).select("work_id").distinct()
    return config.with_knobs(w, knob_table(w)).select("work_id", "max_chars", "overlap_sentences", "threshold", "chapter_mode")


def knob_table(w: DataFrame) -> DataFrame:
    raw = F.when(F.col("work_id") % 3 == 0, F.concat(F.lit('{"max_chars": '), (F.col("work_id") + 300).cast("string"), F.lit("}"))).when(
        F.col("work_id") % 3 == 1, F.lit('{"overlap_sentences": 0, "threshold": 0.6}')
    )
    return config.parse_knobs(w.withColumn("knobs", raw).filter("knobs IS NOT NULL"))


@R.add(
    "a3_knobbed_chunks",
    query(
        [DOCS, KNOB_SQL, CHUNKS[1], CHUNKS[2].replace("<= a.s + 1500", "<= a.s + a.mc").replace("FROM sn a", "FROM (SELECT sn.*, kb.max_chars AS mc FROM sn JOIN kb USING (work_id)) a").replace(
            "greatest(w.i + 1, l.last + 1 - 1)", "CASE WHEN w.work_id % 3 = 1 THEN l.last + 1 ELSE greatest(w.i + 1, l.last + 1 - 1) END")],
        "SELECT work_id, count(*) AS chunks, max(char_end - char_start) AS longest FROM ck GROUP BY ALL",
        recursive=True,
    ),
)
def knobbed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunking under per-work knobs."""
    k = work_knobs(spark, d)
    c = P.chunk_chapters(chapters(spark, d).join(k, "work_id"), F.col("max_chars"), F.col("overlap_sentences"))
    return c.groupBy("work_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.col("char_end") - F.col("char_start")).alias("longest"))


@R.add(
    "a13_gold_labels",
    """SELECT d.source AS work_slug, CAST(l.doc_id AS INTEGER) AS chapter_ordinal, t.text, t.type FROM labels l JOIN documents d ON d.doc_id = l.doc_id,
    LATERAL (VALUES ('quality ' || l.quality, 'Concept'), ('toxic ' || l.toxic, 'Event')) t(text, type)""",
)
def gold_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels written as gold JSON documents and read back."""
    g = A.table(spark, d, "labels").join(A.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    entity = lambda name, kind: F.struct(F.concat(F.lit(name + " "), F.col(name).cast("string")).alias("text"), F.lit(kind).alias("type"))
    path = scratch(spark, "gold")
    g.select(F.col("source").alias("work_slug"), F.col("doc_id").alias("chapter_ordinal"), F.array(entity("quality", "Concept"), entity("toxic", "Event")).alias("entities")).write.json(path)
    return files.gold_entities(spark, path, multi_line=False)


# ------------------------------------------------------------------ tables


@R.add(
    "a5_stored_tables",
    query(
        [*STAR_CTES, STAR_PROPS],
        """SELECT 'nodes' AS name, count(*) AS n, CAST(sum(node_id % 1000003) AS BIGINT) AS id_sum FROM snodes UNION ALL SELECT 'edges', count(*), CAST(sum(edge_id % 1000003) AS BIGINT) FROM sedges
        UNION ALL SELECT 'node_properties', count(*), CAST(sum(prop_id % 1000003) AS BIGINT) FROM sprops""",
    ),
)
def stored_tables(spark: SparkSession, d: str) -> DataFrame:
    s = star_store(spark, d)
    row = lambda t, key: s.rows(t).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(key) % 1000003).alias("id_sum")).select(F.lit(t).alias("name"), "n", "id_sum")
    return row("nodes", "node_id").unionByName(row("edges", "edge_id")).unionByName(row("node_properties", "prop_id"))


@R.add("a6_ordered_scan", query(STAR_CTES[:2], "SELECT work_id, node_id, name, row_number() OVER (PARTITION BY work_id ORDER BY type, name, node_id) AS place FROM snodes"))
def ordered_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every work's nodes in list order, with their place: the sort is a range partitioning, not one task per work."""
    return number_by_range(star_nodes(spark, d).select("work_id", "node_id", "type", "name"), ["work_id"], ["type", "name", "node_id"], "place").drop("type")


@R.add("a6_table_counts", query(STAR_CTES, "SELECT work_id, count(*) AS n FROM sedges GROUP BY ALL"))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    s = new_store(spark)
    s.write("edges", star_edges(spark, d))
    return s.counts("edges")


@R.add(
    "a7_get_or_create_works",
    """WITH n AS (SELECT lower(n_name) AS slug, n_name AS title FROM nation WHERE n_regionkey % 2 = 1)
    SELECT CAST(n_nationkey AS BIGINT) + 1 AS work_id, lower(n_name) AS slug, 'stored' AS title FROM nation WHERE n_regionkey % 2 = 0
    UNION ALL SELECT (SELECT max(n_nationkey) + 1 FROM nation WHERE n_regionkey % 2 = 0) + row_number() OVER (ORDER BY slug), slug, title FROM n""",
)
def get_or_create(spark: SparkSession, d: str) -> DataFrame:
    n = A.table(spark, d, "nation")
    have = n.filter("n_regionkey % 2 = 0").select((F.col("n_nationkey") + 1).cast("long").alias("work_id"), F.lower("n_name").alias("slug"), F.lit("stored").alias("title"))
    return get_or_create_works(have, n.select(F.lower("n_name").alias("slug"), F.col("n_name").alias("title")))


def per_table(s: GraphStore, tables: list[str]) -> DataFrame:
    out = None
    for t in tables:
        row = s.counts(t).select(F.lit(t).alias("name"), "work_id", "n")
        out = row if out is None else out.unionByName(row)
    return out


@R.add(
    "a8_deleted_works",
    query(
        [*STAR_CTES, STAR_PROPS],
        """SELECT 'nodes' AS name, work_id, count(*) AS n FROM snodes WHERE work_id NOT IN (2, 4) GROUP BY ALL UNION ALL SELECT 'edges', work_id, count(*) FROM sedges WHERE work_id NOT IN (2, 4) GROUP BY ALL
        UNION ALL SELECT 'node_properties', work_id, count(*) FROM sprops WHERE work_id NOT IN (2, 4) GROUP BY ALL""",
    ),
)
def deleted_works(spark: SparkSession, d: str) -> DataFrame:
    s = star_store(spark, d)
    even = A.table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("work_id")).filter("work_id % 2 = 0")
    s.delete_works(even, ["nodes", "edges", "node_properties"])
    return per_table(s, ["nodes", "edges", "node_properties"])


@R.add(
    "a9_deleted_chapters",
    query(
        [*CHUNKS, *ENTITY_CTES[1:]],
        """SELECT 'chapters' AS name, work_id, count(*) AS n FROM ch WHERE ordinal % 3 <> 0 GROUP BY ALL UNION ALL SELECT 'mentions', work_id, count(*) FROM men WHERE chapter_ordinal % 3 <> 0 GROUP BY ALL
        UNION ALL SELECT 'chunks', work_id, count(*) FROM ck WHERE chapter_ordinal % 3 <> 0 GROUP BY ALL""",
        recursive=True,
    ),
)
def deleted_chapters(spark: SparkSession, d: str) -> DataFrame:
    s = new_store(spark)
    s.write("chapters", chapters(spark, d))
    s.write("chunks", P.chunk_chapters(chapters(spark, d)))
    s.write("mentions", linked(spark, d))
    s.delete_chapters(chapters(spark, d).filter("ordinal % 3 = 0").select("work_id", "ordinal"))
    return per_table(s, ["chapters", "chunks", "mentions"])


@R.add(
    "a9_deleted_nodes",
    query(
        [*STAR_CTES, STAR_PROPS],
        """SELECT 'nodes' AS name, work_id, count(*) AS n FROM snodes WHERE node_id % 4 <> 0 GROUP BY ALL UNION ALL SELECT 'edges', work_id, count(*) FROM sedges WHERE source_id % 4 <> 0 AND target_id % 4 <> 0 GROUP BY ALL
        UNION ALL SELECT 'node_properties', work_id, count(*) FROM sprops WHERE node_id % 4 <> 0 GROUP BY ALL""",
    ),
)
def deleted_nodes(spark: SparkSession, d: str) -> DataFrame:
    s = star_store(spark, d)
    s.write("mentions", linked(spark, d))
    s.delete_nodes(star_nodes(spark, d).filter("node_id % 4 = 0"))
    return per_table(s, ["nodes", "edges", "node_properties"])


@R.add(
    "a10_replaced_tier",
    query(STAR_CTES, """SELECT work_id % 2 = 1 AS rebuilt, tier, count(*) FILTER (tier <> 2 OR work_id % 2 = 0 OR edge_id % 2 = 0) AS edges, count(*) FILTER (tier = 2 AND work_id % 2 = 1 AND edge_id % 2 = 0) AS fresh
    FROM sedges GROUP BY ALL"""),
)
def replaced_tier(spark: SparkSession, d: str) -> DataFrame:
    """Tier 2 of every other work rebuilt with half of its edges; the other works and tiers keep theirs."""
    s = new_store(spark)
    s.write("edges", star_edges(spark, d))
    odd = star_edges(spark, d).filter("work_id % 2 = 1")
    s.replace_tier(2, odd.filter("tier = 2 AND edge_id % 2 = 0").withColumn("evidence", F.lit("fresh")), odd)
    return s.rows("edges").groupBy((F.col("work_id") % 2 == 1).alias("rebuilt"), "tier").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("evidence") == "fresh").alias("fresh"))


@R.add("a11_rebuilt_nodes", query(ENTITY_CTES, "SELECT work_id, count(*) AS n FROM nodes GROUP BY ALL"))
def rebuilt_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The derived table replaced as a whole: nothing of the old content stays."""
    s = new_store(spark)
    s.write("nodes", star_nodes(spark, d))
    s.write("nodes", doc_nodes(spark, d))
    return s.counts("nodes")


# ------------------------------------------------------------------ rebuild of changed works

EARLIER = DOCS.replace("\nch AS (", "\nch AS (SELECT * FROM (", 1) + " WHERE NOT (work_id % 2 = 1 AND ordinal % 4 = 0))"


def rebuilt(spark: SparkSession, d: str) -> tuple[GraphStore, int]:
    """A store built without every fourth chapter of odd works, into which all chapters then arrive; and its first snapshot."""
    s = new_store(spark)
    spans = lambda ch, _chunks, _tagger: E.keep_scored(E.map_labels(A.word_spans(ch))).drop("label")
    now = chapters(spark, d).select("work_id", "ordinal", F.lit(None).cast("string").alias("title"), "clean_text", "content_hash", F.lit(None).cast("string").alias("source_path"))
    build.build(s, now.filter("NOT (work_id % 2 = 1 AND ordinal % 4 = 0)"), E.tag_gazetteer, spans=spans)
    before = s.snapshots()[-1]
    build.rebuild(s, now, E.tag_gazetteer, spans=spans)
    return s, before


@R.add(
    "a3_knobbed_build",
    query([c.replace("score >= 0.4", "score >= CASE WHEN work_id % 3 = 1 THEN 0.6 ELSE 0.4 END") for c in ENTITY_CTES], "SELECT work_id, type, count(*) AS entities, sum(importance) AS mentions FROM nodes GROUP BY ALL"),
)
def knobbed_build(spark: SparkSession, d: str) -> DataFrame:
    """A whole build in which a third of the works asks for a higher score, another for longer chunks."""
    s = new_store(spark)
    now = chapters(spark, d).select("work_id", "ordinal", F.lit(None).cast("string").alias("title"), "clean_text", "content_hash", F.lit(None).cast("string").alias("source_path"))
    spans = lambda ch, _chunks, _tagger: E.map_labels(A.word_spans(ch)).drop("label")
    build.build(s, now, E.tag_gazetteer, spans=spans, knobs=knob_table(now.select("work_id").distinct()))
    return s.rows("nodes").groupBy("work_id", "type").agg(F.count(F.lit(1)).alias("entities"), F.sum("importance").alias("mentions"))


@R.add("b20_rebuilt_entities", query(ENTITY_CTES, f"SELECT n.work_id, n.type, n.name, n.importance, n.first_seen_chapter, md5({snippet('c.clean_text', 'ev_s', 'ev_e', 40)}) AS evidence_hash FROM nodes n JOIN ch c ON c.work_id = n.work_id AND c.ordinal = n.ev_ch"))
def rebuilt_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities after an incremental rebuild are those of a build from nothing."""
    s, _ = rebuilt(spark, d)
    return s.rows("nodes").select("work_id", "type", "name", "importance", "first_seen_chapter", F.md5(F.col("evidence").cast("binary")).alias("evidence_hash"))


@R.add(
    "b20_kept_ids",
    query(ENTITY_CTES, "SELECT n.work_id, count(*) AS entities, count(o.host) AS kept FROM nodes n LEFT JOIN (WITH " + ",".join([EARLIER, *ENTITY_CTES[1:]]) + "\nSELECT work_id, type, host FROM nodes) o ON o.work_id = n.work_id AND o.type = n.type AND o.host = n.host GROUP BY ALL"),
)
def kept_ids(spark: SparkSession, d: str) -> DataFrame:
    """Entities found again in a rebuild, under the id they had."""
    s, before = rebuilt(spark, d)
    named = lambda n: s.rows("nodes", n).select("work_id", "node_id").join(s.rows("node_ids", n).select("node_id", "type", "norm"), "node_id")
    old = named(before).withColumn("had", F.lit(True))
    both = named(None).join(old, ["work_id", "node_id", "type", "norm"], "left")
    return both.groupBy("work_id").agg(F.count(F.lit(1)).alias("entities"), F.count("had").alias("kept"))


@R.add(
    "e2_restamped_edges",
    query(
        STAR_CTES,
        """SELECT e.work_id, e.tier, count(*) AS edges FROM sedges e JOIN snodes s ON s.node_id = e.source_id JOIN snodes t ON t.node_id = e.target_id
        WHERE greatest(e.revealed_chapter, s.revealed_chapter + CASE WHEN s.node_id % 3 = 0 THEN 5 ELSE 0 END, t.revealed_chapter + CASE WHEN t.node_id % 3 = 0 THEN 5 ELSE 0 END) <= 24 GROUP BY ALL""",
    ),
)
def restamped_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every third node is revealed five chapters later by a write of nodes alone: the stored edges follow."""
    s = star_store(spark, d)
    later = F.col("revealed_chapter") + F.when(F.col("node_id") % 3 == 0, 5).otherwise(0)
    s.write("nodes", star_nodes(spark, d).withColumn("revealed_chapter", later))
    return s.visible_edges(24).groupBy("work_id", "tier").agg(F.count(F.lit(1)).alias("edges"))


QUERIES, ORACLES = R.queries, R.oracles
