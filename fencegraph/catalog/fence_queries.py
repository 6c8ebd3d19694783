"""Fenced reads over the star graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fencegraph.catalog.base import STAR_CTES, STAR_PROPS, query
from fencegraph.catalog.registry import Registry
from fencegraph.functions.lineage import stored, scratch
from fencegraph.operators import fence
from fencegraph.sources import adaptors as A
from fencegraph.sources.store import GraphStore

R = Registry()
N = 24
NODE_COLS = ["work_id", "node_id", "type", "name", "importance", "first_seen_chapter", "revealed_chapter"]
EDGE_COLS = ["work_id", "edge_id", "source_id", "target_id", "relation", "tier", "first_seen_chapter", "revealed_chapter"]


def star_lines(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, ("star_lines", d), lambda: A.star_lines(spark, d))


def star_nodes(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, ("star_nodes", d), lambda: A.star_nodes(spark, d, star_lines(spark, d)))


def star_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with their effective reveal, laid out by it so that a fence skips row groups."""
    return stored(
        spark, ("star_edges", d),
        lambda: A.star_edges(spark, d, star_lines(spark, d), star_nodes(spark, d)).sortWithinPartitions("effective_reveal"),
    )


def star_properties(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, ("star_properties", d), lambda: A.star_properties(spark, d, star_nodes(spark, d)))


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return star_nodes(spark, d), star_edges(spark, d), star_properties(spark, d)


@R.add(
    "e2_edge_counts_at_position",
    query(STAR_CTES, f"SELECT work_id, tier, count(*) AS edges, CAST(sum(effective_reveal) AS BIGINT) AS reveal_sum FROM seff WHERE effective_reveal <= {N} GROUP BY ALL"),
)
def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, _ = graph(spark, d)
    return fence.visible_edges(edges, nodes, N).groupBy("work_id", "tier").agg(
        F.count(F.lit(1)).alias("edges"), F.sum("effective_reveal").alias("reveal_sum")
    )


@R.add("e1_visible_nodes", query(STAR_CTES[:2], f"SELECT {', '.join(NODE_COLS)} FROM snodes WHERE revealed_chapter <= {N}"))
def visible_nodes(spark: SparkSession, d: str) -> DataFrame:
    return fence.visible_nodes(star_nodes(spark, d), N).select(*NODE_COLS)


@R.add("e2_visible_edges", query(STAR_CTES, f"SELECT {', '.join(EDGE_COLS)} FROM seff WHERE effective_reveal <= {N}"))
def visible_edges(spark: SparkSession, d: str) -> DataFrame:
    return fence.visible_edges(star_edges(spark, d).drop("effective_reveal"), star_nodes(spark, d), N).select(*EDGE_COLS)


@R.add(
    "e3_visible_properties",
    query([*STAR_CTES[:2], STAR_PROPS], f"SELECT work_id, prop_id, node_id, key, value, revealed_chapter FROM sprops WHERE greatest(revealed_chapter, node_reveal) <= {N}"),
)
def visible_properties(spark: SparkSession, d: str) -> DataFrame:
    return fence.visible_properties(star_properties(spark, d), star_nodes(spark, d), N).select(
        "work_id", "prop_id", "node_id", "key", "value", "revealed_chapter"
    )


def detail_requests(nodes: DataFrame) -> DataFrame:
    """One request per entity, at a position that depends on the entity."""
    return nodes.select("work_id", "node_id", (F.col("node_id") % 80).cast("int").alias("n"))


@R.add(
    "e5_entity_details",
    query(
        [*STAR_CTES, STAR_PROPS],
        """, req AS (SELECT work_id, node_id, CAST(node_id % 80 AS INTEGER) AS n, revealed_chapter FROM snodes),
        rq AS (SELECT work_id, node_id, n FROM req WHERE revealed_chapter <= n),
        parts AS (SELECT work_id, node_id, n, 'node' AS part, node_id AS id FROM rq
          UNION ALL SELECT r.work_id, r.node_id, r.n, 'edge', e.edge_id FROM rq r JOIN seff e ON (e.source_id = r.node_id OR e.target_id = r.node_id) AND e.effective_reveal <= r.n
          UNION ALL SELECT r.work_id, r.node_id, r.n, 'property', p.prop_id FROM rq r JOIN sprops p ON p.node_id = r.node_id AND p.revealed_chapter <= r.n)
        SELECT work_id, node_id, n, part, count(*) AS items, CAST(sum(id % 1000003) AS BIGINT) AS id_sum FROM parts GROUP BY ALL""".lstrip(),
    ),
)
def entity_details(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, props = graph(spark, d)
    got = fence.entity_details(detail_requests(nodes), nodes, edges, props)
    return got.groupBy("work_id", "node_id", "n", "part").agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("id") % 1000003).alias("id_sum"))


@R.add("e6_entity_listing", query(STAR_CTES[:2], f"SELECT work_id, count(*) AS entities FROM snodes WHERE revealed_chapter <= {N} GROUP BY ALL"))
def entity_listing(spark: SparkSession, d: str) -> DataFrame:
    return fence.entity_listing(star_nodes(spark, d), N)


COLLAPSED = f"""
vis AS (SELECT * FROM seff WHERE effective_reveal <= {N}),
col AS (SELECT work_id, source_id, target_id, edge_id, relation, tier, revealed_chapter, effective_reveal, first_edge_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY edge_id DESC) AS rk,
         min(edge_id) OVER (PARTITION BY source_id, target_id) AS first_edge_id FROM vis) WHERE rk = 1)"""


@R.add(
    "e7_projected_nodes",
    query(
        [*STAR_CTES[:2], STAR_PROPS],
        f""", pv AS (SELECT node_id, key, value, row_number() OVER (PARTITION BY node_id, key ORDER BY prop_id DESC) AS rk FROM sprops WHERE greatest(revealed_chapter, node_reveal) <= {N})
        SELECT n.work_id, n.node_id, n.name, coalesce(p.props, '') AS props FROM snodes n LEFT JOIN
          (SELECT node_id, string_agg(key || '=' || value, ';' ORDER BY key) AS props FROM pv WHERE rk = 1 GROUP BY node_id) p ON p.node_id = n.node_id
        WHERE n.revealed_chapter <= {N}""",
    ),
)
def projected_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, props = graph(spark, d)
    vn, _ = fence.project(nodes, edges, props, N)
    flat = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return vn.select("work_id", "node_id", "name", F.array_join(flat, ";").alias("props"))


@R.add("e7_projected_edges", query([*STAR_CTES, COLLAPSED], "SELECT source_id, target_id, edge_id, relation, tier, first_edge_id FROM col"))
def projected_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, props = graph(spark, d)
    _, ve = fence.project(nodes, edges, props, N)
    return ve.select("source_id", "target_id", "edge_id", "relation", "tier", "first_edge_id")


@R.add("e7_projected_multigraph", query(STAR_CTES, f"SELECT source_id, target_id, count(*) AS parallel FROM seff WHERE effective_reveal <= {N} GROUP BY ALL HAVING count(*) > 1"))
def projected_multigraph(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, props = graph(spark, d)
    _, ve = fence.project(nodes, edges, props, N, collapse=False)
    return ve.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("parallel")).filter("parallel > 1")


@R.add("e8_library", query([], "x AS (SELECT CAST(conv_id AS BIGINT) AS work_id, count(*) AS chapter_count FROM conversations GROUP BY ALL) SELECT work_id, 'conversation-' || work_id AS slug, chapter_count FROM x"))
def library(spark: SparkSession, d: str) -> DataFrame:
    return fence.library(conv_works(spark, d), A.conv_chapters(spark, d)).select("work_id", "slug", "chapter_count")


def conv_works(spark: SparkSession, d: str) -> DataFrame:
    w = A.table(spark, d, "conversations").select(F.col("conv_id").alias("work_id")).distinct()
    slug = F.concat(F.lit("conversation-"), F.col("work_id").cast("string"))
    return w.select("work_id", slug.alias("slug"), F.concat(F.lit("Conversation "), F.col("work_id").cast("string")).alias("title"))


def region_works(spark: SparkSession, d: str) -> DataFrame:
    """One work per region, and one more that has no nodes."""
    r = A.table(spark, d, "region").select((F.col("r_regionkey").cast("long") + 1).alias("work_id"), F.lower("r_name").alias("slug"), F.col("r_name").alias("title"))
    return r.unionByName(r.agg((F.max("work_id") + 1).alias("work_id")).select("work_id", F.lit("empty").alias("slug"), F.lit("Empty").alias("title")))


@R.add(
    "e9_readiness",
    query(
        STAR_CTES[:2],
        """, w AS (SELECT CAST(r_regionkey AS BIGINT) + 1 AS work_id, lower(r_name) AS slug FROM region UNION ALL SELECT CAST(max(r_regionkey) AS BIGINT) + 2, 'empty' FROM region),
        c AS (SELECT work_id, count(*) AS k FROM snodes GROUP BY ALL)
        SELECT w.work_id, slug, CASE WHEN k > 0 THEN 'ready' ELSE 'unknown' END AS state, coalesce(k, 0) AS node_count FROM w LEFT JOIN c ON c.work_id = w.work_id""",
    ),
)
def readiness(spark: SparkSession, d: str) -> DataFrame:
    return fence.readiness(region_works(spark, d), star_nodes(spark, d))


@R.add(
    "e10_request_positions",
    """WITH r AS (SELECT user_id AS work_id, CAST(floor(value) AS BIGINT) - 20 AS n FROM events)
    SELECT work_id, count(*) AS requests, count(*) FILTER (n >= 0) AS accepted, CAST(coalesce(max(n) FILTER (n >= 0), -1) AS BIGINT) AS deepest FROM r GROUP BY ALL""",
)
def request_positions(spark: SparkSession, d: str) -> DataFrame:
    """A table of requested positions: only integers >= 0 are read."""
    r = A.table(spark, d, "events").select(F.col("user_id").alias("work_id"), (F.floor("value") - 20).alias("n"))
    ok = F.col("n") >= 0
    return r.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("accepted"), F.coalesce(F.max(F.when(ok, F.col("n"))), F.lit(-1)).cast("long").alias("deepest")
    )


@R.add(
    "e11_edge_timeline",
    query(
        STAR_CTES,
        """, p AS (SELECT work_id, effective_reveal AS chapter, count(*) AS appearing FROM seff GROUP BY ALL)
        SELECT work_id, chapter, appearing, CAST(sum(appearing) OVER (PARTITION BY work_id ORDER BY chapter) AS BIGINT) AS visible FROM p""",
    ),
)
def edge_timeline(spark: SparkSession, d: str) -> DataFrame:
    _, edges, _ = graph(spark, d)
    return fence.timeline(edges, "effective_reveal")


@R.add(
    "e11_bloom_delta",
    query(STAR_CTES[:2], "SELECT work_id, node_id, 'vanishes' AS change FROM snodes WHERE revealed_chapter > 3 AND revealed_chapter <= 9"),
)
def bloom(spark: SparkSession, d: str) -> DataFrame:
    return fence.bloom_delta(star_nodes(spark, d), "revealed_chapter", "node_id", 9, 3)


@R.add(
    "e12_fence_audit",
    query(
        STAR_CTES,
        """, bad AS (SELECT e.*, CAST(CASE WHEN e.edge_id % 7 = 0 THEN effective_reveal - 1 - e.edge_id % 5 ELSE effective_reveal END AS INTEGER) AS stored, s.revealed_chapter AS sr, t.revealed_chapter AS tr
          FROM seff e JOIN snodes s ON s.node_id = e.source_id JOIN snodes t ON t.node_id = e.target_id)
        SELECT work_id, count(*) AS edges, CAST(sum(greatest(0, revealed_chapter - stored) + greatest(0, sr - stored) + greatest(0, tr - stored)) AS BIGINT) AS violations, max(stored) AS last_position FROM bad GROUP BY ALL""",
    ),
)
def audit(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh stamp is set too early; the audit must find just these positions."""
    too_early = F.when(F.col("edge_id") % 7 == 0, 1 + F.col("edge_id") % 5).otherwise(0)  # ids need not travel to the ends
    edges = star_edges(spark, d).select("work_id", "source_id", "target_id", "revealed_chapter", too_early.cast("int").alias("too_early"))
    met = fence.with_ends(edges, star_nodes(spark, d))
    stamped = met.withColumn("effective_reveal", F.greatest("revealed_chapter", "s_reveal", "t_reveal") - F.col("too_early"))
    return fence.audit(stamped, star_nodes(spark, d))


@R.add(
    "e12_stored_fence",
    query(STAR_CTES, f"SELECT work_id, tier, count(*) AS edges, CAST(sum(effective_reveal) AS BIGINT) AS reveal_sum, CAST(0 AS BIGINT) AS violations FROM seff WHERE effective_reveal <= {N} GROUP BY ALL"),
)
def stored_fence(spark: SparkSession, d: str) -> DataFrame:
    """A read at a position through the store, whose stamps were made when the edges were written, and the audit of what came back."""
    s = GraphStore(spark, scratch(spark, "store"))
    s.write("nodes", star_nodes(spark, d))
    s.write("edges", star_edges(spark, d).drop("effective_reveal"))
    shown = s.visible_edges(N)
    found = fence.audit(shown, s.rows("nodes")).select("work_id", "violations")
    return shown.groupBy("work_id", "tier").agg(F.count(F.lit(1)).alias("edges"), F.sum("effective_reveal").alias("reveal_sum")).join(found, "work_id")


@R.add(
    "a12_graph_payload",
    query(
        [*STAR_CTES, STAR_PROPS, COLLAPSED],
        f"""SELECT work_id, 'node' AS kind, count(*) AS elements FROM snodes WHERE revealed_chapter <= {N} GROUP BY ALL
        UNION ALL SELECT work_id, 'edge', count(*) FROM col GROUP BY ALL""",
    ),
)
def payload(spark: SparkSession, d: str) -> DataFrame:
    """The payload written as text, one JSON element per line, and read back."""
    from fencegraph.sources import files

    nodes, edges, props = graph(spark, d)
    return files.read_payload(spark, files.write_payload(fence.payload_lines(*fence.project(nodes, edges, props, N)))).groupBy("work_id", "kind").agg(
        F.count(F.lit(1)).alias("elements")
    )


QUERIES, ORACLES = R.queries, R.oracles
