"""Graph analytics over the fenced star graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fencegraph import vocab
from fencegraph.catalog.base import STAR_CTES, query, sql_case
from fencegraph.catalog.fence_queries import COLLAPSED, N
from fencegraph.catalog.registry import Registry
from fencegraph.functions.lineage import stored
from fencegraph.operators import analytics as G
from fencegraph.operators import fence
from fencegraph.sources import adaptors as A

R = Registry()
VIEW = f"""
vn AS (SELECT * FROM snodes WHERE revealed_chapter <= {N}),
dg AS (SELECT n.work_id, n.node_id, n.type, n.name, coalesce(k, 0) AS degree FROM vn n LEFT JOIN
  (SELECT id, count(*) AS k FROM (SELECT source_id AS id FROM col UNION ALL SELECT target_id FROM col) GROUP BY id) x ON x.id = n.node_id)"""
CTES = [*STAR_CTES, COLLAPSED, VIEW]
MIN = 40
HIDE = f"""
mx AS (SELECT work_id, max(degree) AS max_degree FROM dg GROUP BY ALL),
hd AS (SELECT d.*, (type = 'Character' AND name = lower(name)) AS background,
         degree < least({MIN}, max_degree) OR (type = 'Character' AND name = lower(name)) AS hidden FROM dg d JOIN mx USING (work_id)),
sh AS (SELECT * FROM col WHERE source_id NOT IN (SELECT node_id FROM hd WHERE hidden) AND target_id NOT IN (SELECT node_id FROM hd WHERE hidden))"""


def early(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(lines, nodes) up to chapter N: the fence taken to the lines. Edges and nodes are revealed at their first chapter or later, so a line after N
    shows nothing at N and alters no first chapter up to N. What counts all lines of a node, its importance, is left out."""
    lines = stored(spark, ("star_early_lines", d), lambda: A.star_lines(spark, d, N))
    cols = ["work_id", "node_id", "type", "name", "first_seen_chapter", "revealed_chapter"]
    return lines, stored(spark, ("star_early_nodes", d), lambda: A.star_nodes(spark, d, lines).select(*cols))


def payload(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The collapsed payload at N, as a reader gets it."""
    lines, nodes = early(spark, d)
    vn = fence.visible_nodes(nodes, N)

    def shown() -> DataFrame:
        told, others = [fence.visible_edges(e.drop("method", "evidence"), nodes, N) for e in A.star_edge_kinds(spark, d, lines, nodes)]  # no view asks for these
        return fence.collapse_parallel(told, ("o_custkey",)).unionByName(fence.collapse_parallel(others))

    return vn, stored(spark, ("star_payload", d), shown)


@R.add("g1_degrees", query(CTES, "SELECT work_id, node_id, degree FROM dg"))
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(*payload(spark, d)).select("work_id", "node_id", "degree")


@R.add("g1_max_degree", query(CTES, "SELECT work_id, max(degree) AS max_degree FROM dg GROUP BY ALL"))
def max_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.max_degrees(G.degrees(*payload(spark, d)))


@R.add("g2_degree_filter", query([*CTES, HIDE], f"SELECT h.work_id, node_id, degree FROM hd h JOIN mx USING (work_id) WHERE degree >= least({MIN}, max_degree)"))
def degree_filter(spark: SparkSession, d: str) -> DataFrame:
    nd, _ = G.view(*payload(spark, d), min_degree=MIN, hide_background=False)
    return nd.filter("NOT hidden").select("work_id", "node_id", "degree")


@R.add("g3_background_counts", query(CTES, "SELECT work_id, count(*) FILTER (type = 'Character' AND name = lower(name)) AS background, count(*) AS nodes FROM dg GROUP BY ALL"))
def background(spark: SparkSession, d: str) -> DataFrame:
    vn, _ = payload(spark, d)
    return vn.groupBy("work_id").agg(F.count_if(G.is_background(F.col("type"), F.col("name"))).alias("background"), F.count(F.lit(1)).alias("nodes"))


@R.add(
    "g4_view_counts",
    query(
        [*CTES, HIDE],
        """, e AS (SELECT work_id, count(*) AS k FROM sh GROUP BY ALL)
        SELECT h.work_id, count(*) FILTER (NOT hidden) AS shown_nodes, count(*) FILTER (hidden) AS hidden_nodes, coalesce(any_value(e.k), 0) AS shown_edges
        FROM hd h LEFT JOIN e USING (work_id) GROUP BY h.work_id""",
    ),
)
def view_counts(spark: SparkSession, d: str) -> DataFrame:
    nd, shown = G.view(*payload(spark, d), min_degree=MIN)
    n = nd.groupBy("work_id").agg(F.count_if(~F.col("hidden")).alias("shown_nodes"), F.count_if("hidden").alias("hidden_nodes"))
    e = shown.groupBy("work_id").agg(F.count(F.lit(1)).alias("shown_edges"))
    return n.join(e, "work_id", "left").withColumn("shown_edges", F.coalesce("shown_edges", F.lit(0)).cast("long"))


@R.add(
    "g5_neighbourhoods",
    query(
        CTES,
        """, f AS (SELECT work_id, node_id FROM vn),
        a AS (SELECT source_id AS u, target_id AS v, edge_id FROM col UNION ALL SELECT target_id, source_id, edge_id FROM col),
        h AS (SELECT DISTINCT f.work_id, f.node_id AS focus_id, 'node' AS kind, a.v AS id FROM f JOIN a ON a.u = f.node_id
          UNION SELECT f.work_id, f.node_id, 'edge', a.edge_id FROM f JOIN a ON a.u = f.node_id UNION SELECT work_id, node_id, 'node', node_id FROM f)
        SELECT work_id, focus_id, kind, count(*) AS items FROM h GROUP BY ALL""",
    ),
)
def neighbourhoods(spark: SparkSession, d: str) -> DataFrame:
    vn, ve = payload(spark, d)
    hood = G.neighbourhood(vn, ve)
    return hood.groupBy("work_id", "focus_id", "kind").agg(F.count(F.lit(1)).alias("items"))


@R.add(
    "g6_type_isolation",
    query(
        CTES,
        """, lit AS (SELECT work_id, node_id FROM vn WHERE type = 'Place')
        SELECT work_id, 'node' AS kind, count(*) AS items FROM lit GROUP BY ALL
        UNION ALL SELECT work_id, 'edge', count(*) FROM col WHERE source_id IN (SELECT node_id FROM lit) AND target_id IN (SELECT node_id FROM lit) GROUP BY ALL
        UNION ALL SELECT work_id, 'person-place', count(*) FROM col WHERE source_id IN (SELECT node_id FROM vn WHERE type IN ('Character')) AND target_id IN (SELECT node_id FROM lit) GROUP BY ALL""",
    ),
)
def type_isolation(spark: SparkSession, d: str) -> DataFrame:
    vn, ve = payload(spark, d)
    lit, inside = G.isolate_type(vn, ve, "Place")
    count = lambda df, kind: df.groupBy("work_id").agg(F.count(F.lit(1)).alias("items")).select("work_id", F.lit(kind).alias("kind"), "items")
    people = vn.filter("type = 'Character'").select(F.col("node_id").alias("source_id"))
    across = ve.join(people, "source_id", "left_semi").join(lit.select(F.col("node_id").alias("target_id")), "target_id", "left_semi")
    return count(lit, "node").unionByName(count(inside, "edge")).unionByName(count(across, "person-place"))


_EMPTY_PATH = "CAST([] AS STRUCT(s BIGINT, fp BIGINT, e BIGINT, t BIGINT)[])"


@R.add(
    "g7_shortest_paths",
    query(
        [
            *CTES,
            """
rq AS (SELECT a.work_id, a.node_id AS start_id, b.node_id AS end_id FROM vn a JOIN vn b ON a.work_id = b.work_id AND a.type = 'Title' AND b.type IN ('Event', 'Concept'))""",
            """
adj AS (SELECT source_id AS u, target_id AS v, {'s': source_id, 'fp': first_edge_id, 'e': edge_id, 't': target_id} AS p FROM col
  UNION ALL SELECT target_id, source_id, {'s': source_id, 'fp': first_edge_id, 'e': edge_id, 't': target_id} FROM col)""",
            f"""
found(root, node, path) USING KEY (root, node) AS (
  SELECT DISTINCT start_id, start_id, {_EMPTY_PATH} FROM rq
  UNION SELECT f.root, adj.v, min(list_append(f.path, adj.p)) FROM found f JOIN adj ON f.node = adj.u
  LEFT JOIN recurring.found z ON z.root = f.root AND z.node = adj.v WHERE z.root IS NULL GROUP BY f.root, adj.v)""",
        ],
        """SELECT rq.work_id, rq.start_id, rq.end_id, CAST(len(path) AS INTEGER) AS hops, list_transform(path, lambda x: x.e) AS edge_ids
        FROM rq LEFT JOIN found z ON z.root = rq.start_id AND z.node = rq.end_id""",
        recursive=True,
    ),
)
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every title to every event and concept of its work, however far."""
    vn, ve = payload(spark, d)
    a = vn.filter("type = 'Title'").select("work_id", F.col("node_id").alias("start_id"))
    b = vn.filter("type IN ('Event', 'Concept')").select("work_id", F.col("node_id").alias("end_id"))
    p = G.shortest_paths(a.join(b, "work_id"), ve)
    return p.select("work_id", "start_id", "end_id", "hops", "edge_ids")


CONN = """
cx AS (SELECT work_id, source_id AS node_id, target_id AS neighbor_id, edge_id, relation, tier, revealed_chapter AS chapter, true AS outgoing FROM col
  UNION ALL SELECT work_id, target_id, source_id, edge_id, relation, tier, revealed_chapter, false FROM col WHERE source_id <> target_id)"""


@R.add("g8_connections", query([*CTES, CONN], "SELECT c.work_id, c.node_id, c.edge_id, c.neighbor_id, n.name AS label, n.type AS neighbor_type, relation, tier, chapter, outgoing, row_number() OVER (PARTITION BY c.work_id, c.node_id ORDER BY tier DESC, chapter, n.name, c.edge_id) AS place FROM cx c JOIN vn n ON n.node_id = c.neighbor_id"))
def connections(spark: SparkSession, d: str) -> DataFrame:
    vn, ve = payload(spark, d)
    return G.in_list_order(G.connections(vn, ve), G.list_ends(ve)).drop("relation_label", "step_label")


@R.add("g9_last_links", query([*CTES, CONN], "SELECT work_id, node_id, max(chapter) AS last_link FROM cx GROUP BY ALL"))
def last_links(spark: SparkSession, d: str) -> DataFrame:
    return G.last_links(G.connections(*payload(spark, d)))


@R.add(
    "g10_relation_labels",
    query(CTES, f"SELECT relation, {sql_case('relation', vocab.DISPLAY_LABELS, repr(''))} AS label, {sql_case('relation', vocab.DISPLAY_LABELS, repr('linked'))} AS step_label, count(*) AS edges FROM col GROUP BY relation"),
)
def relation_labels(spark: SparkSession, d: str) -> DataFrame:
    _, ve = payload(spark, d)
    c = ve.groupBy("relation").agg(F.count(F.lit(1)).alias("edges"))
    return c.select("relation", vocab.relation_label(F.col("relation")).alias("label"), vocab.relation_step_label(F.col("relation")).alias("step_label"), "edges")


@R.add("g11_node_sizes", query(CTES, "SELECT work_id, node_id, CAST(floor(20 + 8 * sqrt(degree) + 0.5) AS BIGINT) AS size FROM dg"))
def node_sizes(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(*payload(spark, d)).select("work_id", "node_id", G.node_size(F.col("degree")).alias("size"))


QUERIES, ORACLES = R.queries, R.oracles
