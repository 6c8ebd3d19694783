"""Graph analytics over the fenced payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencegraph import vocab
from fencegraph.functions.components import connected
from fencegraph.functions.lineage import cut
from fencegraph.functions.ranking import number_lists


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges per node, both ends counted, isolated nodes 0. Counted before the join, so hubs cost one row."""
    ends = edges.select("work_id", F.explode(F.array("source_id", "target_id")).alias("node_id"))
    d = ends.groupBy("work_id", "node_id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(d, ["work_id", "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def max_degrees(with_degree: DataFrame) -> DataFrame:
    return with_degree.groupBy("work_id").agg(F.max("degree").alias("max_degree"))


def is_background(node_type: Column, label: Column) -> Column:
    """A character whose label has no capital: a generic reference rather than a name."""
    return (node_type == "Character") & (label == F.lower(label))


def view(nodes: DataFrame, edges: DataFrame, *, min_degree: int = 2, hide_background: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes with degree and ``hidden``, edges with both ends shown); the threshold is clamped to the work's maximum."""
    nd = degrees(nodes, edges)
    nd = nd.join(max_degrees(nd), "work_id")
    least = F.when(F.col("max_degree") > 0, F.least(F.lit(min_degree), F.col("max_degree"))).otherwise(F.lit(min_degree))
    low = (least > 0) & (F.col("degree") < least)
    back = is_background(F.col("type"), F.col("name")) if hide_background else F.lit(False)
    nd = nd.withColumn("background", is_background(F.col("type"), F.col("name"))).withColumn("hidden", low | back)
    hidden = nd.filter("hidden").select(F.col("node_id").alias("h"))
    shown = edges.join(hidden, F.col("source_id") == F.col("h"), "left_anti").join(hidden, F.col("target_id") == F.col("h"), "left_anti")
    return nd, shown


def neighbourhood(focus: DataFrame, edges: DataFrame) -> DataFrame:
    """Closed one-hop neighbourhood of every focus node: (work_id, focus_id, kind, id)."""
    hood = F.array(
        F.struct(F.col("source_id").alias("focus_id"), F.col("target_id").alias("other")),
        F.struct(F.col("target_id").alias("focus_id"), F.col("source_id").alias("other")),
    )
    around = edges.select("work_id", "edge_id", F.explode(hood).alias("x")).select("work_id", "edge_id", "x.focus_id", "x.other")
    at = focus.select("work_id", F.col("node_id").alias("focus_id")).join(around, ["work_id", "focus_id"])
    parts = F.array(
        F.struct(F.lit("node").alias("kind"), F.col("other").alias("id")), F.struct(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"))
    )
    rows = at.select("work_id", "focus_id", F.explode(parts).alias("p")).select("work_id", "focus_id", "p.kind", "p.id").distinct()
    own = focus.select("work_id", F.col("node_id").alias("focus_id"), F.lit("node").alias("kind"), F.col("node_id").alias("id"))
    return rows.filter((F.col("kind") == "edge") | (F.col("id") != F.col("focus_id"))).unionByName(own)


def isolate_type(nodes: DataFrame, edges: DataFrame, node_type: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a type and the edges inside it."""
    lit = nodes.filter(F.col("type") == node_type)
    ids = lit.select(F.col("node_id").alias("k"))
    inside = edges.join(ids, F.col("source_id") == F.col("k"), "left_semi").join(ids, F.col("target_id") == F.col("k"), "left_semi")
    return lit, inside


def list_ends(edges: DataFrame) -> DataFrame:
    """Both ends of every edge as entries of their connection lists, without labels; a loop is one entry."""
    both = F.array(
        F.struct(F.col("source_id").alias("node_id"), F.col("target_id").alias("neighbor_id"), F.lit(True).alias("outgoing")),
        F.struct(F.col("target_id").alias("node_id"), F.col("source_id").alias("neighbor_id"), F.lit(False).alias("outgoing")),
    )
    c = edges.select("work_id", "edge_id", "relation", "tier", F.col("revealed_chapter").alias("chapter"), F.explode(both).alias("x"))
    return c.select("work_id", "edge_id", "relation", "tier", "chapter", "x.*").filter((F.col("node_id") != F.col("neighbor_id")) | F.col("outgoing"))


def connections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connection list of every node, in no order (see ``in_list_order``)."""
    label = nodes.select(F.col("node_id").alias("neighbor_id"), F.col("name").alias("label"), F.col("type").alias("neighbor_type"))
    return list_ends(edges).join(label, "neighbor_id", "left").select(
        "work_id", "node_id", "edge_id", "neighbor_id", F.coalesce("label", F.col("neighbor_id").cast("string")).alias("label"),
        F.coalesce("neighbor_type", F.lit("")).alias("neighbor_type"), "relation", "tier", "chapter", "outgoing",
        vocab.relation_label(F.col("relation")).alias("relation_label"), vocab.relation_step_label(F.col("relation")).alias("step_label"),
    )


def in_list_order(conns: DataFrame, ends: DataFrame | None = None, **how: int) -> DataFrame:
    """Add ``place``, from 1, in the list of the node: highest tier first, then by chapter, label and edge. A hub's list is numbered by
    tier and chapter, never sorted whole. ``ends``: the entries without labels (``list_ends``), so that counting hubs joins none."""
    level = (F.lit(9) - F.col("tier")) * F.lit(1 << 32) + F.col("chapter")
    return number_lists(conns, ["work_id", "node_id"], level, [F.col("label"), F.col("edge_id")], "place", F.col("edge_id"), among=ends, **how)


def last_links(conns: DataFrame) -> DataFrame:
    return conns.groupBy("work_id", "node_id").agg(F.max("chapter").alias("last_link"))


def node_size(degree: Column) -> Column:
    return F.floor(F.lit(20) + F.lit(8) * F.sqrt(degree) + F.lit(0.5))


def shortest_paths(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """Shortest undirected path of every request (request_id, start_id, end_id) over payload edges.

    Requests between different components are answered at once. For the others distances are counted breadth first, level by level,
    from the ends that are asked for, until all their starts are met; then every request walks down from its start, at each
    node along the smallest edge place that brings it a step closer. What is kept of a node met is its distance alone. Of
    several shortest paths that is the one a queue-based search gives: the smallest sequence of edge places, an edge's
    place being (source, first edge id of its ordered pair). Each level is written out. ``hops`` is null when the ends are
    not connected.
    """
    place = F.struct("source_id", F.col("first_edge_id" if "first_edge_id" in edges.columns else "edge_id").alias("at"), "edge_id", "target_id")
    both = F.array(F.struct(F.col("source_id").alias("u"), F.col("target_id").alias("v")), F.struct(F.col("target_id").alias("u"), F.col("source_id").alias("v")))
    adj = cut(edges.select(place.alias("place"), F.explode(both).alias("x")).select("x.u", "x.v", "place").filter("u <> v"), "adjacency")
    part = cut(connected(adj, "u", "v"), "components")
    of = lambda end: part.select(F.col("node").alias(end), F.col("component").alias(f"__{end}"))
    asked = requests.select("start_id", "end_id").distinct()
    linked = asked.join(of("start_id"), "start_id").join(of("end_id"), "end_id").filter("__start_id = __end_id AND start_id <> end_id").select("start_id", "end_id")
    linked = cut(linked, "linked")
    # distances to each end, until its starts are met
    frontier = cut(linked.select(F.col("end_id").alias("goal"), F.col("end_id").alias("node")).distinct().withColumn("far", F.lit(0)), "level")
    seen, far = frontier, 0
    waiting = linked.select(F.col("end_id").alias("goal"), F.col("start_id").alias("node"))
    while True:
        waiting = cut(waiting.join(frontier.select("goal", "node"), ["goal", "node"], "left_anti"), "waiting")
        if waiting.isEmpty():
            break
        far += 1
        live = frontier.join(waiting.select("goal").distinct(), "goal", "left_semi")
        step = live.join(adj, live.node == adj.u).select("goal", F.col("v").alias("node")).distinct()
        # a node next to the last level lies on it, on the one before, or is new
        recent = seen.filter(F.col("far") >= far - 2).select("goal", "node")
        frontier = cut(step.join(recent, ["goal", "node"], "left_anti").withColumn("far", F.lit(far)), "level")
        seen = seen.unionByName(frontier)
    # every request walks down, a step a round
    distance = seen.select("goal", F.col("node").alias("next"), F.col("far").alias("left"))
    at = linked.join(seen, (F.col("end_id") == F.col("goal")) & (F.col("start_id") == F.col("node"))).select("start_id", "end_id", "node", F.col("far").alias("hops"), F.col("far").alias("togo"))
    at, steps = cut(at, "walk"), None
    for i in range(far):
        now = at.filter(F.col("togo") > 0)
        choice = now.join(adj, F.col("node") == F.col("u")).join(distance, (F.col("goal") == F.col("end_id")) & (F.col("next") == F.col("v")) & (F.col("left") == F.col("togo") - 1))
        best = choice.groupBy("start_id", "end_id").agg(F.min(F.struct("place", "v")).alias("b"), F.first("togo").alias("togo"))
        taken = cut(best.select("start_id", "end_id", F.lit(i).alias("i"), F.col("b.place.edge_id").alias("edge_id"), F.col("b.v").alias("node"), (F.col("togo") - 1).alias("togo")), "step")
        steps = taken if steps is None else steps.unionByName(taken)
        at = taken
    path = at.select("start_id", "end_id").limit(0).withColumn("p", F.array().cast("array<struct<i:int,edge_id:bigint,node:bigint>>")) if steps is None else steps.groupBy("start_id", "end_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "edge_id", "node"))).alias("p")
    )
    here = requests.join(path, ["start_id", "end_id"], "left")
    same = F.col("start_id") == F.col("end_id")
    known = F.when(same, F.array().cast("array<struct<i:int,edge_id:bigint,node:bigint>>")).otherwise(F.col("p"))
    return here.withColumn("p", known).select(
        *requests.columns, F.when(F.col("p").isNotNull(), F.size("p")).alias("hops"),
        F.when(F.col("p").isNotNull(), F.concat(F.array("start_id"), F.transform("p", lambda x: x["node"]))).alias("node_ids"),
        F.transform("p", lambda x: x["edge_id"]).alias("edge_ids"),
    )
