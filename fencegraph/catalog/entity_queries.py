"""Entity extraction and resolution over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fencegraph import vocab
from fencegraph.catalog.base import CLUSTERS, DOCS, ENTITY_CTES, FOLDS, MENTION_CTES, NAMES, SPANS, TOKENS, norm, query, snippet, sql_case
from fencegraph.catalog.registry import Registry
from fencegraph.functions import text as X
from fencegraph.functions.lineage import stored
from fencegraph.operators import entities as E
from fencegraph.sources import adaptors as A

R = Registry()
MENTION_COLS = ["work_id", "mention_id", "chapter_ordinal", "ordinal", "surface", "type", "char_start", "char_end", "score"]


def chapters(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, ("doc_chapters", d), lambda: A.doc_chapters(spark, d))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, ("doc_mentions", d), lambda: A.doc_mentions(spark, d))


def names(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, ("doc_names", d), lambda: E.names(mentions(spark, d)))


def folds(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, ("doc_folds", d), lambda: E.fold_names(names(spark, d)))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, ("doc_clusters", d), lambda: E.entity_clusters(mentions(spark, d), folds(spark, d)))


def doc_nodes(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, ("doc_nodes", d), lambda: E.build_nodes(clusters(spark, d), chapters(spark, d)))


def unquoted_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The same nodes without evidence, for which no text is read again."""
    return stored(spark, ("doc_unquoted", d), lambda: E.build_nodes(clusters(spark, d), None))


def linked(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, ("doc_linked", d), lambda: E.link_mentions(mentions(spark, d), folds(spark, d), unquoted_nodes(spark, d)))


@R.add("c2_typed_spans", query([DOCS, TOKENS, SPANS], f"SELECT work_id, chapter_ordinal, label, {sql_case('label', vocab.LABEL_TYPES)} AS type, count(*) AS spans FROM spans WHERE label NOT IN ('gadget', 'mood') GROUP BY ALL"))
def typed_spans(spark: SparkSession, d: str) -> DataFrame:
    return E.map_labels(A.doc_spans(spark, d)).groupBy("work_id", "chapter_ordinal", "label", "type").agg(F.count(F.lit(1)).alias("spans"))


@R.add("a4_extra_labels", query([DOCS, TOKENS, SPANS], f"SELECT work_id, {sql_case('label', {**vocab.LABEL_TYPES, 'gadget': 'Item'})} AS type, count(*) AS spans FROM spans WHERE label <> 'mood' GROUP BY ALL"))
def extra_labels(spark: SparkSession, d: str) -> DataFrame:
    return E.map_labels(A.doc_spans(spark, d), {"gadget": "Item"}).groupBy("work_id", "type").agg(F.count(F.lit(1)).alias("spans"))


@R.add("c3_scored_spans", query([DOCS, TOKENS, SPANS], "SELECT work_id, count(*) AS spans, min(score) AS lowest FROM spans WHERE score >= coalesce(CASE WHEN work_id % 2 = 0 THEN 0.7 END, 0.4) GROUP BY ALL"))
def scored_spans(spark: SparkSession, d: str) -> DataFrame:
    """Threshold 0.4, raised to 0.7 for even works by a per-work knob."""
    knob = F.when(F.col("work_id") % 2 == 0, F.lit(0.7))
    return E.keep_scored(A.doc_spans(spark, d), knob).groupBy("work_id").agg(F.count(F.lit(1)).alias("spans"), F.min("score").alias("lowest"))


@R.add("c5_numbered_mentions", query(MENTION_CTES, f"SELECT {', '.join(MENTION_COLS)} FROM men"))
def numbered_mentions(spark: SparkSession, d: str) -> DataFrame:
    return E.number_mentions(E.keep_scored(E.map_labels(A.doc_spans(spark, d)))).select(*MENTION_COLS)


@R.add("c6_surface_norms", query([*MENTION_CTES], f", q AS (SELECT '  \"The ' || surface || ',\" ' AS s FROM men) SELECT {norm('s')} AS norm, count(*) AS mentions FROM q GROUP BY ALL"))
def surface_norms(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.lit('  "The '), F.col("surface"), F.lit(',\" '))
    return mentions(spark, d).groupBy(X.normalize_surface(s).alias("norm")).agg(F.count(F.lit(1)).alias("mentions"))


@R.add("c7_majority_types", query([*MENTION_CTES, NAMES], "SELECT work_id, norm, type, CAST(members AS BIGINT) AS members, first_pos FROM nm"))
def majority_types(spark: SparkSession, d: str) -> DataFrame:
    return E.names(mentions(spark, d)).select("work_id", "norm", "type", "members", "first_pos")


@R.add("c8_folded_names", query([*MENTION_CTES, NAMES, FOLDS], "SELECT work_id, norm, host FROM fold"))
def folded_names(spark: SparkSession, d: str) -> DataFrame:
    return E.fold_names(names(spark, d)).select("work_id", "norm", "host")


@R.add("c9_canonical_names", query([*MENTION_CTES, NAMES, FOLDS, CLUSTERS], "SELECT work_id, host, type, name FROM clu"))
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    return E.entity_clusters(mentions(spark, d), folds(spark, d)).select("work_id", "host", "type", "name")


@R.add(
    "c10_cluster_attributes",
    query(
        [*MENTION_CTES, NAMES, FOLDS, CLUSTERS],
        """, sb AS (SELECT work_id, host, 'S' || (ordinal % 7) AS subtype, row_number() OVER (PARTITION BY work_id, host ORDER BY seq) AS rk FROM mo WHERE ordinal % 3 = 0)
        SELECT c.work_id, c.host, c.first_seen_chapter, c.mention_count, s.subtype FROM clu c LEFT JOIN sb s ON s.work_id = c.work_id AND s.host = c.host AND s.rk = 1""",
    ),
)
def cluster_attributes(spark: SparkSession, d: str) -> DataFrame:
    sub = F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("S"), (F.col("ordinal") % 7).cast("string")))
    m = mentions(spark, d).withColumn("subtype", sub)
    return E.entity_clusters(m, folds(spark, d)).select("work_id", "host", "first_seen_chapter", "mention_count", "subtype")


@R.add(
    "c11_entity_evidence",
    query(ENTITY_CTES, f"SELECT n.work_id, n.name, {snippet('c.clean_text', 'n.ev_s', 'n.ev_e', 40)} AS evidence FROM nodes n JOIN ch c ON c.work_id = n.work_id AND c.ordinal = n.ev_ch"),
)
def entity_evidence(spark: SparkSession, d: str) -> DataFrame:
    return doc_nodes(spark, d).select("work_id", "name", "evidence")


@R.add("c12_nodes", query(ENTITY_CTES, "SELECT work_id, node_id, type, name, importance, first_seen_chapter, revealed_chapter FROM nodes"))
def node_table(spark: SparkSession, d: str) -> DataFrame:
    n = E.build_nodes(E.entity_clusters(mentions(spark, d), folds(spark, d)), None)
    return n.select("work_id", "node_id", "type", "name", "importance", "first_seen_chapter", "revealed_chapter")


@R.add("c13_linked_mentions", query(ENTITY_CTES, "SELECT work_id, mention_id, node_id FROM lm"))
def linked_mentions(spark: SparkSession, d: str) -> DataFrame:
    return E.link_mentions(mentions(spark, d), folds(spark, d), doc_nodes(spark, d)).select("work_id", "mention_id", "node_id")


@R.add(
    "c14_extraction_report",
    query(
        ENTITY_CTES,
        """, m AS (SELECT work_id, count(*) AS mentions FROM men GROUP BY ALL)
        SELECT n.work_id, coalesce(n.type, 'ALL') AS type, count(*) AS entities, any_value(m.mentions) AS mentions FROM nodes n JOIN m ON m.work_id = n.work_id
        GROUP BY GROUPING SETS ((n.work_id), (n.work_id, n.type))""",
    ),
)
def report(spark: SparkSession, d: str) -> DataFrame:
    return E.extraction_report(mentions(spark, d), doc_nodes(spark, d))


QUERIES, ORACLES = R.queries, R.oracles
