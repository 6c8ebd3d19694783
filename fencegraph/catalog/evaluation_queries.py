"""Evaluation and data quality over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fencegraph import vocab
from fencegraph.catalog.base import STAR_CTES, hex_int, norm, query, sql_list
from fencegraph.catalog.entity_queries import doc_nodes
from fencegraph.catalog.fence_queries import star_edges, star_nodes
from fencegraph.catalog.identity_queries import VERDICTS, judged
from fencegraph.catalog.registry import Registry
from fencegraph.catalog.relation_queries import ACC, EDGES1, edges1
from fencegraph.catalog.social_queries import CTES as SOCIAL_CTES
from fencegraph.catalog.social_queries import edges2
from fencegraph.functions import text as X
from fencegraph.operators import evaluate as H
from fencegraph.operators import quality
from fencegraph.sources import adaptors as A

R = Registry()
SCORES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0.0 END AS f1"""
COUNTS = "count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn"
LABELLED = """
lb AS (SELECT l.doc_id, 'quality' AS kind, quality = 1 AS g, n_chars > 1000 AS p, least(1.0, n_chars / 4000.0) AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id
       UNION ALL SELECT l.doc_id, 'toxic', toxic = 1, contains(text, ' | ') OR n_chars < 300, least(1.0, n_chars / 4000.0) FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Gold and predicted (doc_id, kind) flags of labelled documents, and a score."""
    docs = A.table(spark, d, "documents").select("doc_id", "n_chars", F.contains(F.col("text"), F.lit(" | ")).alias("table_like"))
    j = A.table(spark, d, "labels").join(docs, "doc_id")
    kinds = F.array(
        F.struct(F.lit("quality").alias("kind"), (F.col("quality") == 1).alias("g"), (F.col("n_chars") > 1000).alias("p")),
        F.struct(F.lit("toxic").alias("kind"), (F.col("toxic") == 1).alias("g"), (F.col("table_like") | (F.col("n_chars") < 300)).alias("p")),
    )
    return j.select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("s"), F.explode(kinds).alias("k")).select("doc_id", "s", "k.*")


@R.add("h1_scores", query([LABELLED], f", c AS (SELECT {COUNTS} FROM lb) SELECT *, {SCORES} FROM c"))
def scores(spark: SparkSession, d: str) -> DataFrame:
    x = labelled(spark, d)
    return H.prf1(x.filter("g"), x.filter("p"), ["doc_id", "kind"])


@R.add("h2_scores_by_kind", query([LABELLED], f", c AS (SELECT coalesce(kind, 'ALL') AS kind, {COUNTS} FROM lb GROUP BY GROUPING SETS ((kind), ())) SELECT *, {SCORES} FROM c"))
def scores_by_kind(spark: SparkSession, d: str) -> DataFrame:
    x = labelled(spark, d)
    return H.prf1_by(x.filter("g"), x.filter("p"), ["doc_id", "kind"], "kind")


@R.add(
    "h6_threshold_sweep",
    query(
        [LABELLED],
        f""", t AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold),
        c AS (SELECT kind, threshold, count(*) FILTER (g AND s >= threshold) AS tp, count(*) FILTER (NOT g AND s >= threshold) AS fp, count(*) FILTER (g AND s < threshold) AS fn FROM lb, t GROUP BY ALL)
        SELECT *, {SCORES} FROM c""",
    ),
)
def sweep(spark: SparkSession, d: str) -> DataFrame:
    x = labelled(spark, d)
    return H.threshold_sweep(x.filter("g"), x, ["doc_id", "kind"], "s", by=["kind"])


# ------------------------------------------------------------------ triples of the document graph

TRIPLES = f"""
tn AS (SELECT e.work_id, e.edge_id, s.name AS source_name, e.relation, t.name AS target_name FROM se e JOIN nodes s ON s.node_id = e.source_id JOIN nodes t ON t.node_id = e.target_id),
al AS (SELECT work_id, {norm("name")} AS norm, 'n' || node_id AS canonical FROM nodes WHERE {hex_int("name", 1, 1)} < 12),
pt AS (SELECT DISTINCT work_id, CASE WHEN list_contains({sql_list(vocab.SYMMETRIC_SOCIAL)}, relation) THEN least(a, b) ELSE a END AS source, relation,
              CASE WHEN list_contains({sql_list(vocab.SYMMETRIC_SOCIAL)}, relation) THEN greatest(a, b) ELSE b END AS target
       FROM (SELECT t.work_id, s.canonical AS a, t.relation, o.canonical AS b FROM tn t JOIN al s ON s.work_id = t.work_id AND s.norm = {norm("t.source_name")}
             JOIN al o ON o.work_id = t.work_id AND o.norm = {norm("t.target_name")} WHERE s.canonical <> o.canonical)),
gt AS (SELECT DISTINCT work_id, CASE WHEN list_contains({sql_list(vocab.SYMMETRIC_SOCIAL)}, relation) THEN least(a, b) ELSE a END AS source, relation,
              CASE WHEN list_contains({sql_list(vocab.SYMMETRIC_SOCIAL)}, relation) THEN greatest(a, b) ELSE b END AS target
       FROM (SELECT work_id, 'n' || source_id AS a, CASE WHEN edge_id % 7 = 0 THEN 'Killed' ELSE relation END AS relation, 'n' || target_id AS b FROM se WHERE edge_id % 5 <> 0)),
tm AS (SELECT coalesce(g.relation, p.relation) AS relation, g.work_id IS NOT NULL AS g, p.work_id IS NOT NULL AS p FROM gt g FULL JOIN pt p
       ON p.work_id = g.work_id AND p.source = g.source AND p.relation = g.relation AND p.target = g.target)"""
TRIPLE_CTES = [*SOCIAL_CTES, TRIPLES]


def gold_raw(spark: SparkSession, d: str) -> DataFrame:
    """Gold triples made from the social edges: some left out, some renamed, inverse relations written backwards."""
    e = edges2(spark, d).filter("edge_id % 5 <> 0")
    rel = F.when(F.col("edge_id") % 7 == 0, F.lit("Killed")).otherwise(F.col("relation"))
    a, b = F.concat(F.lit("n"), F.col("source_id").cast("string")), F.concat(F.lit("n"), F.col("target_id").cast("string"))
    inverse = {v: k for k, v in vocab.INVERSE_RELATIONS.items()}
    x = e.select("work_id", rel.alias("rel"), a.alias("a"), b.alias("b")).withColumn("inv", vocab.lookup(inverse, F.col("rel")))
    back = F.col("inv").isNotNull()
    return x.select(
        "work_id", F.when(back, F.col("b")).otherwise(F.col("a")).alias("source"), F.coalesce("inv", "rel").alias("relation"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("target")
    )


def gold(spark: SparkSession, d: str) -> DataFrame:
    return H.normal_triples(gold_raw(spark, d)).distinct()


def predicted(spark: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    n = doc_nodes(spark, d)
    canon = F.concat(F.lit("n"), F.col("node_id").cast("string"))
    al = n.filter(A.hex_int(F.col("name"), 1, 1) < 12).select("work_id", X.normalize_surface(F.col("name")).alias("norm"), canon.alias("canonical"))
    named = n.select("node_id", X.normalize_surface(F.col("name")).alias("nn"))
    e = edges.join(named.select(F.col("node_id").alias("source_id"), F.col("nn").alias("source_norm")), "source_id").join(
        named.select(F.col("node_id").alias("target_id"), F.col("nn").alias("target_norm")), "target_id"
    )
    return H.resolve_triples(e, al, ["work_id"])


@R.add("h3_normal_triples", query(TRIPLE_CTES, "SELECT work_id, source, relation, target FROM gt"))
def normal_triples(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select("work_id", "source", "relation", "target")


@R.add("h4_resolved_predictions", query(TRIPLE_CTES, "SELECT work_id, source, relation, target FROM pt"))
def resolved(spark: SparkSession, d: str) -> DataFrame:
    return predicted(spark, d, edges2(spark, d)).select("work_id", "source", "relation", "target")


@R.add("h5_relation_scores", query(TRIPLE_CTES, f", c AS (SELECT coalesce(relation, 'ALL') AS relation, {COUNTS} FROM tm GROUP BY GROUPING SETS ((relation), ())) SELECT *, {SCORES} FROM c"))
def relation_scores(spark: SparkSession, d: str) -> DataFrame:
    return H.prf1_by(gold(spark, d), predicted(spark, d, edges2(spark, d)), ["work_id", "source", "relation", "target"], "relation")


@R.add(
    "h5_pair_coverage",
    query(
        [*TRIPLE_CTES, ACC, EDGES1],
        """, gpp AS (SELECT DISTINCT work_id, least(source, target) AS lo, greatest(source, target) AS hi FROM gt),
        sp AS (SELECT DISTINCT e.work_id, least('n' || source_id, 'n' || target_id) AS lo, greatest('n' || source_id, 'n' || target_id) AS hi FROM edges1 e)
        SELECT count(*) AS gold_pairs, count(sp.lo) AS covered FROM gpp gp LEFT JOIN sp ON sp.work_id = gp.work_id AND sp.lo = gp.lo AND sp.hi = gp.hi""",
    ),
)
def pair_coverage(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    e = edges1(spark, d).select("work_id", n("source_id").alias("source"), n("target_id").alias("target"))
    return H.pair_coverage(gold(spark, d), e, ["work_id"])


# ------------------------------------------------------------------ reveal timing

TARGETS = """
tg AS (SELECT DISTINCT work_id, name_a, name_b, ['ALIAS', 'SAME_AS', NULL][work_id % 3 + 1] AS relation, CASE WHEN work_id % 5 <> 0 THEN CAST(work_id % 4 + 1 AS INTEGER) END AS gold FROM vd),
ls AS (SELECT conv_id AS work_id, CAST(max(turn) + 1 AS INTEGER) AS last FROM conversations GROUP BY ALL),
tl AS (SELECT t.*, coalesce(least(last, gold + 1), last) AS ceiling FROM tg t JOIN ls USING (work_id))"""
VERDICT = """CASE WHEN gold IS NULL THEN CASE WHEN first_yes IS NULL THEN 'PASS' ELSE 'FAIL' END WHEN first_yes IS NULL THEN 'MISS'
WHEN first_yes = gold THEN 'EXACT' WHEN first_yes < gold THEN 'EARLY' ELSE 'LATE' END AS verdict"""


def targets(j: DataFrame) -> DataFrame:
    t = j.select("work_id", "name_a", "name_b").distinct()
    rel = F.element_at(F.array(F.lit("ALIAS"), F.lit("SAME_AS"), F.lit(None)), (F.col("work_id") % 3 + 1).cast("int"))
    return t.withColumn("relation", rel).withColumn("gold", F.when(F.col("work_id") % 5 != 0, (F.col("work_id") % 4 + 1).cast("int")))


def last_chapters(spark: SparkSession, d: str) -> DataFrame:
    return A.conv_chapters(spark, d).groupBy("work_id").agg(F.max("ordinal").alias("last"))


@R.add(
    "h7_reveal_timing",
    query(
        [VERDICTS, TARGETS],
        f""", f AS (SELECT t.work_id, t.name_a, t.name_b, t.relation, t.gold, min(v.k) AS first_yes FROM tl t LEFT JOIN jv v ON v.work_id = t.work_id AND v.name_a = t.name_a AND v.name_b = t.name_b
          AND v.same AND v.relation IS NOT NULL AND v.valid AND (t.relation IS NULL OR t.relation = v.relation) AND v.k <= t.ceiling GROUP BY ALL) SELECT *, {VERDICT} FROM f""",
    ),
)
def reveal_timing(spark: SparkSession, d: str) -> DataFrame:
    j = judged(spark, d)
    return H.timing_report(targets(j), j.filter("same AND relation IS NOT NULL AND valid"), last_chapters(spark, d))


@R.add(
    "h8_presence_timing",
    query(
        [VERDICTS, TARGETS],
        f""", f AS (SELECT t.work_id, t.name_a, t.name_b, CAST(NULL AS VARCHAR) AS relation, t.gold, min(v.k) AS first_yes FROM tl t LEFT JOIN jv v ON v.work_id = t.work_id AND v.name_a = t.name_a AND v.name_b = t.name_b
          AND v.same AND v.relation IS NOT NULL AND v.clue_chapter <= v.k AND v.k <= t.ceiling GROUP BY t.work_id, t.name_a, t.name_b, t.gold) SELECT *, {VERDICT} FROM f""",
    ),
)
def presence_timing(spark: SparkSession, d: str) -> DataFrame:
    j = judged(spark, d)
    return H.timing_report(targets(j), j.filter("same AND relation IS NOT NULL AND clue_chapter <= k"), last_chapters(spark, d), any_relation=True)


@R.add(
    "h9_graded_replies",
    """WITH w AS (SELECT conv_id, turn, regexp_extract(text, '[A-Za-z]+') AS w1, conv_id % 3 AS m FROM conversations)
    SELECT conv_id, turn, turn % 4 <> 2 AS json_ok, turn % 4 IN (0, 1) AND m <> 0 AS asserted FROM w""",
)
def graded(spark: SparkSession, d: str) -> DataFrame:
    """Replies built from turns: two list shapes, broken JSON, no groups; every third conversation asks for a missing name."""
    w = A.table(spark, d, "conversations").withColumn("w1", F.regexp_extract("text", "[A-Za-z]+", 0))
    lists = F.concat(F.lit('{"same_entity": [["Nobody"], ["'), F.col("w1"), F.lit(' the First", " Other One "]]}'))
    cited = F.concat(F.lit('{"same_entity": [{"names": ["Other One", "'), F.col("w1"), F.lit('"], "quote": "x"}]}'))
    turn = F.col("turn") % 4
    reply = F.when(turn == 0, lists).when(turn == 1, cited).when(turn == 2, F.lit('{"same_entity": [')).otherwise(F.lit('{"same_entity": []}'))
    b = F.when(F.col("conv_id") % 3 == 0, F.lit("absent")).otherwise(F.lit("other"))
    ok, hit = H.grade_groups(reply, F.lower("w1"), b)
    return w.select("conv_id", "turn", ok.alias("json_ok"), hit.alias("asserted"))


# ------------------------------------------------------------------ data quality

BROKEN_N = """
bn AS (SELECT work_id, node_id, CASE WHEN node_id % 50 = 0 THEN 'Monster' ELSE type END AS type, CASE WHEN node_id % 7 = 0 THEN 'City' END AS subtype,
              CASE WHEN node_id % 31 = 0 THEN 'guess' ELSE 'gliner' END AS method FROM snodes)"""


@R.add(
    "h10_node_vocabulary",
    query(
        [*STAR_CTES[:2], BROKEN_N],
        """SELECT work_id, node_id AS id, 'type' AS problem FROM bn WHERE type = 'Monster' UNION ALL SELECT work_id, node_id, 'subtype' FROM bn WHERE subtype IS NOT NULL AND type <> 'Place'
        UNION ALL SELECT work_id, node_id, 'method' FROM bn WHERE method = 'guess'""",
    ),
)
def node_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    n = star_nodes(spark, d).withColumn("type", F.when(F.col("node_id") % 50 == 0, "Monster").otherwise(F.col("type")))
    n = n.withColumn("subtype", F.when(F.col("node_id") % 7 == 0, "City")).withColumn("method", F.when(F.col("node_id") % 31 == 0, "guess").otherwise(F.col("method")))
    return quality.node_vocabulary(n)


@R.add(
    "h10_edge_vocabulary",
    query(
        STAR_CTES,
        """SELECT work_id, edge_id AS id, 'relation' AS problem FROM sedges WHERE edge_id % 97 = 0
        UNION ALL SELECT work_id, edge_id, 'tier' FROM sedges WHERE edge_id % 89 = 0 AND edge_id % 97 <> 0 AND tier <> 3""",
    ),
)
def edge_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    e = star_edges(spark, d).withColumn("relation", F.when(F.col("edge_id") % 97 == 0, "Likes").otherwise(F.col("relation")))
    return quality.edge_vocabulary(e.withColumn("tier", F.when(F.col("edge_id") % 89 == 0, 3).otherwise(F.col("tier"))))


@R.add("h11_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(A.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@R.add("h11_dangling_references", query(STAR_CTES, ", k AS (SELECT node_id FROM snodes WHERE node_id % 11 <> 0) SELECT work_id, edge_id, 'source' AS which, source_id AS node_id FROM sedges WHERE source_id NOT IN (FROM k) UNION ALL SELECT work_id, edge_id, 'target', target_id FROM sedges WHERE target_id NOT IN (FROM k)"))
def dangling(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of every edge."""
    kept = star_nodes(spark, d).filter("node_id % 11 <> 0")
    end = lambda which: quality.dangling(star_edges(spark, d), f"{which}_id", kept, "node_id").select("work_id", "edge_id", F.lit(which).alias("which"), F.col(f"{which}_id").alias("node_id"))
    return end("source").unionByName(end("target"))


QUERIES, ORACLES = R.queries, R.oracles
