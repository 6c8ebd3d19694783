"""Reads at a reading position: nothing leaves that is revealed later.

A position is a chapter number, or a column when many positions are read at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencegraph.functions.ranking import running_total


def position(n: int | Column) -> Column:
    """A reading position is mandatory and an integer >= 0: a number is checked before a plan exists, a column row by row."""
    if isinstance(n, Column):
        return F.when(n >= 0, n.cast("long")).otherwise(F.raise_error(F.lit("reading position must be an integer >= 0")).cast("long"))
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError(f"reading position must be an integer >= 0, got {n!r}")
    return F.lit(n)


def visible_nodes(nodes: DataFrame, n: int | Column) -> DataFrame:
    return nodes.filter(F.col("revealed_chapter") <= position(n))


def with_effective_reveal(edges: DataFrame, nodes: DataFrame, *, dangling: bool = False) -> DataFrame:
    """Add ``effective_reveal``: the first position at which the edge and both its ends are revealed.

    Stored once per graph build, it turns every later edge fence into one pushed-down comparison. Edges without an end
    among the nodes go, or with ``dangling`` stay with no position, and so show at none.
    """
    st = with_ends(edges, nodes, dangling=dangling)
    whole = F.col("s_reveal").isNotNull() & F.col("t_reveal").isNotNull()
    return st.withColumn("effective_reveal", F.when(whole, F.greatest("revealed_chapter", "s_reveal", "t_reveal"))).drop("s_reveal", "t_reveal")


def with_ends(edges: DataFrame, nodes: DataFrame, *, dangling: bool = False) -> DataFrame:
    """Add ``s_reveal`` and ``t_reveal``, the reveals of both ends; what stamps and audits the same edges then meets the nodes once."""
    how = "left" if dangling else "inner"
    ends = nodes.select(F.col("node_id").alias("__n"), F.col("revealed_chapter").alias("__r"))
    s = edges.join(ends.withColumnRenamed("__r", "s_reveal"), F.col("source_id") == F.col("__n"), how).drop("__n")
    return s.join(ends.withColumnRenamed("__r", "t_reveal"), F.col("target_id") == F.col("__n"), how).drop("__n")


def visible_edges(edges: DataFrame, nodes: DataFrame, n: int | Column) -> DataFrame:
    """Edges revealed by N whose both ends are revealed by N."""
    at = position(n)
    if "effective_reveal" in edges.columns:
        return edges.filter(F.col("effective_reveal") <= at)
    seen = visible_nodes(nodes, at).select("node_id")
    e = edges.filter(F.col("revealed_chapter") <= at)
    e = e.join(seen.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi")
    return e.join(seen.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi").select(*edges.columns)


def visible_properties(props: DataFrame, nodes: DataFrame, n: int | Column) -> DataFrame:
    """Properties revealed by N of nodes revealed by N."""
    at = position(n)
    seen = visible_nodes(nodes, at).select("node_id")
    return props.filter(F.col("revealed_chapter") <= at).join(seen, "node_id", "left_semi").select(*props.columns)


def visible_chunks(chunks: DataFrame, n: int | Column) -> DataFrame:
    return chunks.filter(F.col("chapter_ordinal") <= position(n))


def property_maps(props: DataFrame) -> DataFrame:
    """node_id -> map of properties; the last property id wins per key."""
    last = props.groupBy("work_id", "node_id", "key").agg(F.max_by("value", "prop_id").alias("value"))
    return last.groupBy("work_id", "node_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("properties")  # distinct keys of one node
    )


def collapse_parallel(edges: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """One edge per ordered pair: the last edge id supplies the attributes, the first one the place in order. ``beside`` are columns that a
    pair determines; edges that are dealt by them stay where they lie."""
    rest = [c for c in edges.columns if c not in ("source_id", "target_id", *beside)]
    c = edges.groupBy(*beside, "source_id", "target_id").agg(F.max_by(F.struct(*rest), "edge_id").alias("__e"), F.min("edge_id").alias("first_edge_id"))
    return c.select("source_id", "target_id", "__e.*", "first_edge_id")


def project(nodes: DataFrame, edges: DataFrame, props: DataFrame, n: int | Column, *, collapse: bool = True) -> tuple[DataFrame, DataFrame]:
    """The graph payload at N: nodes with their property map, and edges."""
    maps = property_maps(visible_properties(props, nodes, n))
    vn = visible_nodes(nodes, n).join(maps, ["work_id", "node_id"], "left").withColumn(
        "properties", F.coalesce("properties", F.create_map().cast("map<string,string>"))
    )
    ve = visible_edges(edges, nodes, n)
    return vn, collapse_parallel(ve) if collapse else ve


def payload_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The payload as one JSON element per line: (work_id, kind, id, json)."""
    n = nodes.select(
        "work_id", F.lit("node").alias("kind"), F.col("node_id").cast("string").alias("id"),
        F.to_json(
            F.struct(
                F.struct(
                    F.col("node_id").cast("string").alias("id"), F.col("name").alias("label"), "type", "subtype", "importance",
                    "first_seen_chapter", "revealed_chapter", F.col("method").alias("extraction_method"),
                    F.col("evidence").alias("evidence_span"), "properties",
                ).alias("data")
            ),
            {"ignoreNullFields": "false"},
        ).alias("json"),
    )
    e = edges.select(
        "work_id", F.lit("edge").alias("kind"), F.concat(F.lit("e"), F.col("edge_id").cast("string")).alias("id"),
        F.to_json(
            F.struct(
                F.struct(
                    F.concat(F.lit("e"), F.col("edge_id").cast("string")).alias("id"), F.col("source_id").cast("string").alias("source"),
                    F.col("target_id").cast("string").alias("target"), "relation", "tier", "first_seen_chapter", "revealed_chapter",
                    F.col("method").alias("extraction_method"), F.col("evidence").alias("evidence_span"),
                ).alias("data")
            ),
            {"ignoreNullFields": "false"},
        ).alias("json"),
    )
    return n.unionByName(e)


def entity_details(requests: DataFrame, nodes: DataFrame, edges: DataFrame, props: DataFrame) -> DataFrame:
    """Many entity reads at once: ``requests`` has (work_id, node_id, n).

    Answers rows (work_id, node_id, n, part, id): the node itself, its visible edges, its visible
    properties. An entity that is unrevealed at N gives no row. Edges need ``effective_reveal``.
    """
    seen = requests.join(nodes.select("work_id", "node_id", "revealed_chapter"), ["work_id", "node_id"]).filter(
        F.col("revealed_chapter") <= position(F.col("n"))
    ).drop("revealed_chapter")
    cols = ["work_id", "node_id", "n"]
    own = seen.select(*cols, F.lit("node").alias("part"), F.col("node_id").alias("id"))
    e = edges.select(
        "work_id", "edge_id", "effective_reveal",
        F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("node_id"),
    )
    inc = seen.join(e, ["work_id", "node_id"]).filter(F.col("effective_reveal") <= F.col("n"))
    p = seen.join(props.select("work_id", "node_id", "prop_id", F.col("revealed_chapter").alias("__r")), ["work_id", "node_id"]).filter(
        F.col("__r") <= F.col("n")
    )
    return own.unionByName(inc.select(*cols, F.lit("edge").alias("part"), F.col("edge_id").alias("id"))).unionByName(
        p.select(*cols, F.lit("property").alias("part"), F.col("prop_id").alias("id"))
    )


def entity_listing(nodes: DataFrame, n: int | Column) -> DataFrame:
    return visible_nodes(nodes, n).groupBy("work_id").agg(F.count(F.lit(1)).alias("entities"))


def library(works: DataFrame, chapters: DataFrame) -> DataFrame:
    """Works with their chapter counts (0 when a work has none)."""
    c = chapters.groupBy("work_id").agg(F.count(F.lit(1)).alias("chapter_count"))
    return works.join(c, "work_id", "left").withColumn("chapter_count", F.coalesce("chapter_count", F.lit(0)).cast("long"))


def readiness(works: DataFrame, nodes: DataFrame) -> DataFrame:
    """A work is ready once it has nodes."""
    c = nodes.groupBy("work_id").agg(F.count(F.lit(1)).alias("node_count"))
    return works.join(c, "work_id", "left").select(
        "work_id", "slug", F.when(F.col("node_count") > 0, "ready").otherwise("unknown").alias("state"),
        F.coalesce("node_count", F.lit(0)).cast("long").alias("node_count"),
    )


def timeline(elements: DataFrame, reveal: str) -> DataFrame:
    """What becomes visible at each position, and the running total: every fence size in one aggregation."""
    per = elements.groupBy("work_id", F.col(reveal).alias("chapter")).agg(F.count(F.lit(1)).alias("appearing"))
    return running_total(per, ["work_id"], "chapter", "appearing", "visible")


def bloom_delta(elements: DataFrame, reveal: str, key: str, old: int, new: int) -> DataFrame:
    """Elements that appear (or vanish) when the reader moves from one position to another."""
    lo, hi = min(old, new), max(old, new)
    position(lo)
    change = F.lit("appears" if new >= old else "vanishes")
    return elements.filter((F.col(reveal) > lo) & (F.col(reveal) <= hi)).select("work_id", key, change.alias("change"))


def audit(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Positions at which an edge shows although a stamp of it or its ends is later, per work; 0 in a sound graph.

    What is audited is the stored ``effective_reveal`` (computed only where edges have none); ends that ``with_ends`` has
    looked up already are not looked up again. Closed form per edge: it
    shows from ``effective_reveal`` on, a stamp forbids every position before the stamp, so the forbidden positions
    that show are ``max(0, stamp - effective_reveal)``.
    """
    both = edges if {"s_reveal", "t_reveal"} <= set(edges.columns) else with_ends(edges, nodes)
    if "effective_reveal" not in edges.columns:
        both = both.withColumn("effective_reveal", F.greatest("revealed_chapter", "s_reveal", "t_reveal"))
    over = lambda c: F.greatest(F.lit(0), F.col(c) - F.col("effective_reveal"))
    return both.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("edges"),
        F.sum(over("revealed_chapter") + over("s_reveal") + over("t_reveal")).alias("violations"),
        F.max("effective_reveal").alias("last_position"),
    )
