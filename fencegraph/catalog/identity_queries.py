"""Tier 3 identity: candidate pairs over ``documents``, verdicts over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fencegraph.catalog.base import ENTITY_CTES, hex_int, query, sql_list
from fencegraph.catalog.entity_queries import doc_nodes, linked
from fencegraph.catalog.registry import Registry
from fencegraph.functions import text as X
from fencegraph.functions.lineage import stored
from fencegraph.operators import identity as T3
from fencegraph.sources import adaptors as A

R = Registry()


def cite(expr: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower({expr}), 'ß', 'ss'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@R.add(
    "d18_candidate_pairs",
    query(
        ENTITY_CTES,
        """, nn AS (SELECT * FROM nodes WHERE type IN ('Character', 'Title')), pc AS (SELECT DISTINCT node_id, chapter_ordinal FROM lm WHERE node_id IS NOT NULL),
        ap AS (SELECT DISTINCT a.work_id, a.node_id AS lo, b.node_id AS hi, a.importance + b.importance AS importance FROM nn a JOIN pc pa ON pa.node_id = a.node_id
          JOIN nn b ON b.work_id = a.work_id AND b.node_id > a.node_id JOIN pc pb ON pb.node_id = b.node_id AND pb.chapter_ordinal = pa.chapter_ordinal),
        tp AS (SELECT *, CAST(row_number() OVER (PARTITION BY work_id ORDER BY importance DESC, lo, hi) AS INTEGER) AS place FROM ap)
        SELECT t.work_id, place, t.importance, CASE WHEN (a.first_seen_chapter, a.name) <= (b.first_seen_chapter, b.name) THEN lo ELSE hi END AS source_id,
          CASE WHEN (a.first_seen_chapter, a.name) <= (b.first_seen_chapter, b.name) THEN hi ELSE lo END AS target_id
        FROM tp t JOIN nn a ON a.node_id = lo JOIN nn b ON b.node_id = hi WHERE place <= 60""",
    ),
)
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return T3.candidate_pairs(doc_nodes(spark, d), linked(spark, d)).select("work_id", "place", "importance", "source_id", "target_id")


@R.add(
    "d19_reading_windows",
    """WITH c AS (SELECT conv_id AS work_id, CAST(turn + 1 AS INTEGER) AS k, length(trim(text)) AS n FROM conversations)
    SELECT work_id, k, count(*) OVER w AS chapters, CAST(sum(n) OVER w + 2 * (count(*) OVER w - 1) AS BIGINT) AS fed_chars FROM c WINDOW w AS (PARTITION BY work_id ORDER BY k)""",
)
def reading_windows(spark: SparkSession, d: str) -> DataFrame:
    return T3.reading_windows(A.conv_chapters(spark, d))


@R.add("d20_normal_citations", f"SELECT conv_id AS work_id, CAST(turn + 1 AS INTEGER) AS ordinal, {cite('text')} AS norm_text FROM conversations")
def normal_citations(spark: SparkSession, d: str) -> DataFrame:
    return A.conv_chapters(spark, d).select("work_id", "ordinal", X.normalize_citation(F.col("clean_text")).alias("norm_text"))


_h = "conv_id || ':' || turn"
_blobs = sql_list(A.RELATION_BLOBS)
_parsed = "['ALIAS', 'SECRET_IDENTITY', 'SAME_AS', 'REINCARNATION', NULL, NULL, NULL, 'TRANSMIGRATED_INTO']"
VERDICTS = f"""
op AS (SELECT conv_id, string_split(text, ' ')[1] AS name_a, string_split(text, ' ')[-1] AS name_b FROM conversations WHERE turn = 0),
v0 AS (SELECT conv_id, turn, {hex_int(_h, 2, 1)} AS d2, {hex_int(_h, 3, 1)} AS d3, {hex_int(_h, 4, 1)} AS d4, {hex_int(_h, 5, 1)} AS d5,
              turn + {hex_int(_h, 1, 1)} % 3 - 1 AS src FROM conversations),
v1 AS (SELECT v.*, o.name_a, o.name_b, a.text AS src_text, p.text AS prior_text FROM v0 v JOIN op o USING (conv_id)
       LEFT JOIN conversations a ON a.conv_id = v.conv_id AND a.turn = v.src LEFT JOIN conversations p ON p.conv_id = v.conv_id AND p.turn = v.src - 1),
v2 AS (SELECT *, CASE WHEN src_text IS NOT NULL THEN array_to_string(string_split(src_text, ' ')[2:6], ' ') END AS inside, right(prior_text, 12) || ' ' || left(src_text, 12) AS seam FROM v1),
vd AS (SELECT conv_id AS work_id, name_a, name_b, CAST(turn + 1 AS INTEGER) AS k, d3 % 4 <> 0 AS same, {_blobs}[d4 % 8 + 1] AS relation_raw, {_parsed}[d4 % 8 + 1] AS relation,
              d4 % 8 = 4 AS malformed, CASE WHEN d5 % 4 = 0 THEN coalesce(seam, inside) WHEN d2 % 4 = 3 THEN reverse(inside) ELSE inside END AS clue FROM v2),
fd AS (SELECT c.conv_id AS work_id, c.turn + 1 AS k, string_agg({cite("e.text")}, ' ' ORDER BY e.turn) AS fed FROM conversations c
       JOIN conversations e ON e.conv_id = c.conv_id AND e.turn <= c.turn GROUP BY ALL),
jd AS (SELECT v.*, (SELECT CAST(min(f.k) AS INTEGER) FROM fd f WHERE f.work_id = v.work_id AND length({cite("coalesce(clue, '')")}) >= 8 AND contains(f.fed, {cite("clue")})) AS clue_chapter,
              (SELECT CAST(min(f.k) AS INTEGER) FROM fd f WHERE f.work_id = v.work_id AND ((length({cite("name_a")}) > 0 AND contains(f.fed, {cite("name_a")}))
                 OR (length({cite("name_b")}) > 0 AND contains(f.fed, {cite("name_b")})))) AS name_chapter FROM vd v),
jv AS (SELECT *, coalesce(clue_chapter <= k, false) AND (relation IS NULL OR relation NOT IN ('TRANSMIGRATED_INTO', 'REINCARNATION') OR coalesce(name_chapter <= k, false)) AS valid FROM jd),
cf AS (SELECT work_id, name_a, name_b, relation, min(k) AS k, regexp_replace(arg_min(clue, k), '^\\s+|\\s+$', '', 'g') AS clue FROM jv WHERE same AND relation IS NOT NULL AND valid GROUP BY ALL)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, ("conv_judged", d), lambda: T3.judge(A.conv_verdicts(spark, d), A.conv_chapters(spark, d)))


@R.add("d21_citable_chapters", query([VERDICTS], "SELECT work_id, name_a, name_b, k, clue, clue_chapter FROM jv"))
def citable(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("work_id", "name_a", "name_b", "k", "clue", "clue_chapter")


@R.add("d22_family_rule", query([VERDICTS], "SELECT work_id, k, relation, name_chapter, valid FROM jv"))
def family_rule(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("work_id", "k", "relation", "name_chapter", "valid")


@R.add("d23_parsed_relations", query([VERDICTS], "SELECT work_id, k, relation_raw, relation, malformed FROM vd"))
def parsed(spark: SparkSession, d: str) -> DataFrame:
    rel = T3.parse_relation(F.col("relation_raw"))
    v = A.conv_verdicts(spark, d).withColumn("relation", rel)
    return v.select("work_id", "k", "relation_raw", "relation", T3.is_malformed(F.col("relation_raw"), F.col("relation")).alias("malformed"))


@R.add("d24_confirmations", query([VERDICTS], "SELECT work_id, name_a, name_b, relation, k, clue FROM cf"))
def confirmations(spark: SparkSession, d: str) -> DataFrame:
    return T3.confirm(judged(spark, d))


def conv_pairs(j: DataFrame) -> DataFrame:
    """The pair of every conversation as nodes: ids descend with the conversation so that some pairs turn."""
    p = j.select("work_id", "name_a", "name_b").distinct()
    lo, hi = F.col("work_id") * 10 + 1, F.col("work_id") * 10 + 2
    odd = F.col("work_id") % 2 == 1
    return p.select(
        "work_id", F.lit(1).alias("place"), "name_a", "name_b", F.when(odd, hi).otherwise(lo).alias("source_id"), F.when(odd, lo).otherwise(hi).alias("target_id"),
        F.lit(1).alias("first_a"), F.lit(2).alias("first_b"),
    )


@R.add(
    "d25_identity_edges",
    query(
        [VERDICTS],
        """, p AS (SELECT *, CASE WHEN work_id % 2 = 1 THEN work_id * 10 + 2 ELSE work_id * 10 + 1 END AS s, CASE WHEN work_id % 2 = 1 THEN work_id * 10 + 1 ELSE work_id * 10 + 2 END AS t,
          row_number() OVER (PARTITION BY work_id ORDER BY k) AS no FROM cf)
        SELECT work_id, work_id * 34359738368 + 25769803776 + 8 + no AS edge_id, CASE WHEN relation = 'SAME_AS' THEN least(s, t) ELSE s END AS source_id,
          CASE WHEN relation = 'SAME_AS' THEN greatest(s, t) ELSE t END AS target_id, relation, 3 AS tier, 1 AS first_seen_chapter, k AS revealed_chapter, 'llm' AS method, clue AS evidence FROM p""",
    ),
)
def identity_edges(spark: SparkSession, d: str) -> DataFrame:
    j = judged(spark, d)
    return T3.identity_edges(T3.confirm(j), conv_pairs(j))


@R.add(
    "d26_identity_report",
    query(
        [VERDICTS],
        """SELECT work_id, count(DISTINCT name_a || '|' || name_b) AS pairs_tested, count(*) FILTER (same AND relation IS NOT NULL AND NOT valid) AS citations_rejected,
        count(*) FILTER (same AND malformed) AS malformed_relations FROM jv GROUP BY ALL""",
    ),
)
def identity_report(spark: SparkSession, d: str) -> DataFrame:
    return T3.identity_report(judged(spark, d))


QUERIES, ORACLES = R.queries, R.oracles
