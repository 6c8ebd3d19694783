"""Tier 2 social relations over ``documents`` (one chunk per chapter)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fencegraph import vocab
from fencegraph.catalog.base import ENTITY_CTES, norm, query, quoted, snippet, sql_list
from fencegraph.catalog.entity_queries import chapters, doc_nodes, linked
from fencegraph.catalog.registry import Registry
from fencegraph.catalog.relation_queries import PAIRS
from fencegraph.functions.lineage import stored
from fencegraph.operators import social as S

R = Registry()
# The corpus is invented prose, so short words that occur in it stand in for the relation phrases.
PHRASES = {
    "the ": "Ally", "of ": "Serves", "and ": "Enemy", "in ": "Mentor", "que ": "Betrayed", "die ": "Parent", "de ": "Respects", "la ": "Family", "er ": "Rival",
}
_vals = ", ".join(f"({quoted(p)}, {quoted(r)})" for p, r in PHRASES.items())
SPANS2 = f"""
ph(phrase, relation) AS (VALUES {_vals}),
gp AS (SELECT p.*, c.clean_text, lower(substr(c.clean_text, p.a_e + 1, p.b_s - p.a_e)) AS gap FROM pr p JOIN ch c ON c.work_id = p.work_id AND c.ordinal = p.chapter_ordinal WHERE p.b_s >= p.a_e),
rs AS (SELECT g.*, ph.phrase, ph.relation, substr(clean_text, a_s + 1, a_e - a_s) AS source_surface, substr(clean_text, b_s + 1, b_e - b_s) AS target_surface,
              1.0::DOUBLE / (1 + length(gap)) AS score, {snippet("clean_text", "a_s", "greatest(a_e, b_e)", 30)} AS evidence FROM gp g JOIN ph ON contains(g.gap, ph.phrase))"""
INDEX = f"""
vt AS (SELECT work_id, norm, node_id, count(*) AS n, min(r) AS r0, arg_min(pos, r * 1000000000000000000000::HUGEINT + pos) AS p0 FROM (
        SELECT work_id, {norm("name")} AS norm, node_id, 0 AS r, node_id AS pos FROM nodes
        UNION ALL SELECT work_id, norm, node_id, 1, mention_id FROM lm WHERE node_id IS NOT NULL) WHERE norm <> '' GROUP BY ALL),
ix AS (SELECT work_id, norm, node_id FROM (SELECT *, row_number() OVER (PARTITION BY work_id, norm ORDER BY n DESC, r0, p0) AS rk FROM vt) WHERE rk = 1),
an AS (SELECT r.*, s.node_id AS src, t.node_id AS tgt, ns.type AS s_type, nt.type AS t_type FROM rs r
       JOIN ix s ON s.work_id = r.work_id AND s.norm = {norm("r.source_surface")} JOIN ix t ON t.work_id = r.work_id AND t.norm = {norm("r.target_surface")}
       JOIN nodes ns ON ns.node_id = s.node_id JOIN nodes nt ON nt.node_id = t.node_id WHERE s.node_id <> t.node_id)"""
_person = sql_list(vocab.PERSON_ONLY)
_symm = sql_list(vocab.SYMMETRIC_SOCIAL)
VALID = f"""
vl AS (SELECT *, CASE WHEN list_contains({_person}, relation) THEN s_type = 'Character' AND t_type = 'Character'
                      ELSE s_type IN ('Character', 'Organization') AND t_type IN ('Character', 'Organization') END AS ok FROM an),
dr AS (SELECT *, CASE WHEN list_contains({_symm}, relation) THEN least(src, tgt) ELSE src END AS source_id,
              CASE WHEN list_contains({_symm}, relation) THEN greatest(src, tgt) ELSE tgt END AS target_id FROM vl WHERE ok),
sa AS (SELECT work_id, source_id, target_id, relation, chapter_ordinal AS first_ch, a_s, a_id, b_s, b_id, phrase,
              min(chapter_ordinal) OVER w AS first_seen_chapter,
              first_value(evidence) OVER (w ORDER BY score DESC, chapter_ordinal, a_s, a_id, b_s, b_id, phrase) AS evidence,
              row_number() OVER (w ORDER BY chapter_ordinal, a_s, a_id, b_s, b_id, phrase) AS rk
       FROM dr WINDOW w AS (PARTITION BY work_id, source_id, target_id, relation)),
se AS (SELECT work_id, work_id * 34359738368 + 17179869184 + row_number() OVER (PARTITION BY work_id ORDER BY first_ch, a_s, a_id, b_s, b_id, phrase, relation) AS edge_id,
              source_id, target_id, relation, first_seen_chapter, evidence FROM sa WHERE rk = 1)"""
CTES = [*ENTITY_CTES, PAIRS, SPANS2, INDEX, VALID]


def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    return chapters(spark, d).select("work_id", F.col("ordinal").alias("chapter_ordinal"), F.lit(0).alias("ordinal"), F.col("clean_text").alias("text"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    m = linked(spark, d).withColumn("chunk_ordinal", F.lit(0))
    return stored(spark, ("doc_relation_spans", d), lambda: S.cue_spans(m, chunk_table(spark, d), PHRASES))


def anchored(spark: SparkSession, d: str) -> DataFrame:
    return S.anchor(spans(spark, d), S.surface_index(doc_nodes(spark, d), linked(spark, d)), doc_nodes(spark, d))


@R.add("d10_relation_spans", query([*ENTITY_CTES, PAIRS, SPANS2], "SELECT work_id, chapter_ordinal, source_surface, phrase, relation, target_surface, score, evidence FROM rs"))
def relation_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d).drop("pos", "chunk_ordinal")


@R.add(
    "d10_default_phrases",
    query(
        [*ENTITY_CTES, PAIRS],
        f""", ph(phrase, relation) AS (VALUES {', '.join(f"({quoted(p)}, {quoted(r)})" for p, r in vocab.RELATION_PHRASES.items())})
        SELECT p.work_id, ph.relation, count(*) AS spans FROM pr p JOIN ch c ON c.work_id = p.work_id AND c.ordinal = p.chapter_ordinal
        JOIN ph ON contains(lower(substr(c.clean_text, p.a_e + 1, p.b_s - p.a_e)), ph.phrase) WHERE p.b_s >= p.a_e GROUP BY ALL""",
    ),
)
def default_phrases(spark: SparkSession, d: str) -> DataFrame:
    m = linked(spark, d).withColumn("chunk_ordinal", F.lit(0))
    return S.cue_spans(m, chunk_table(spark, d)).groupBy("work_id", "relation").agg(F.count(F.lit(1)).alias("spans"))


PARTIAL = {p: r for p, r in PHRASES.items() if p not in ("de ", "er ")}


@R.add("d11_mapped_phrases", query([*ENTITY_CTES, PAIRS, SPANS2], "SELECT work_id, relation, count(*) AS spans FROM rs WHERE phrase NOT IN ('de ', 'er ') GROUP BY ALL"))
def mapped_phrases(spark: SparkSession, d: str) -> DataFrame:
    return S.map_phrases(spans(spark, d), PARTIAL).groupBy("work_id", "relation").agg(F.count(F.lit(1)).alias("spans"))


@R.add("d12_surface_index", query([*ENTITY_CTES, PAIRS, SPANS2, INDEX], "SELECT work_id, norm, node_id FROM ix"))
def surface_index(spark: SparkSession, d: str) -> DataFrame:
    return S.surface_index(doc_nodes(spark, d), linked(spark, d))


@R.add("d13_anchored_spans", query([*ENTITY_CTES, PAIRS, SPANS2, INDEX], "SELECT work_id, chapter_ordinal, src AS source_id, tgt AS target_id, s_type AS source_type, t_type AS target_type, relation, score FROM an"))
def anchored_spans(spark: SparkSession, d: str) -> DataFrame:
    return anchored(spark, d).select("work_id", "chapter_ordinal", "source_id", "target_id", "source_type", "target_type", "relation", "score")


@R.add(
    "d14_rejected_relations",
    query(CTES, "SELECT work_id, relation, count(DISTINCT least(src, tgt) || '-' || greatest(src, tgt)) AS rejected FROM vl WHERE NOT ok GROUP BY ALL"),
)
def rejected(spark: SparkSession, d: str) -> DataFrame:
    return S.split_valid(anchored(spark, d))[1].groupBy("work_id", "relation").agg(F.count(F.lit(1)).alias("rejected"))


@R.add("d15_directed_spans", query(CTES, "SELECT work_id, source_id, target_id, relation, count(*) AS spans FROM dr GROUP BY ALL"))
def directed(spark: SparkSession, d: str) -> DataFrame:
    v, _ = S.split_valid(anchored(spark, d))
    return S.canonical_direction(v).groupBy("work_id", "source_id", "target_id", "relation").agg(F.count(F.lit(1)).alias("spans"))


@R.add("d16_best_evidence", query(CTES, "SELECT work_id, source_id, target_id, relation, first_seen_chapter, evidence FROM se"))
def best_evidence(spark: SparkSession, d: str) -> DataFrame:
    v, _ = S.split_valid(anchored(spark, d))
    return S.accumulate(S.canonical_direction(v)).drop("first_at")


def edges2(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, ("doc_social", d), lambda: S.build_social(spans(spark, d), doc_nodes(spark, d), linked(spark, d))[0])


@R.add("d17_social_edges", query(CTES, "SELECT work_id, edge_id, source_id, target_id, relation, 2 AS tier, first_seen_chapter, first_seen_chapter AS revealed_chapter, 'gliner' AS method FROM se"))
def social_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges2(spark, d).drop("evidence")


@R.add(
    "d17_social_report",
    query(
        CTES,
        """SELECT work_id, relation, count(*) AS edges FROM se GROUP BY ALL UNION ALL
        SELECT work_id, '(rejected)', count(*) FROM (SELECT DISTINCT work_id, least(src, tgt), greatest(src, tgt), relation FROM vl WHERE NOT ok) GROUP BY ALL""",
    ),
)
def social_report(spark: SparkSession, d: str) -> DataFrame:
    return S.social_report(edges2(spark, d), S.split_valid(anchored(spark, d))[1])


QUERIES, ORACLES = R.queries, R.oracles
