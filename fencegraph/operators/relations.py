"""Tier 1: structural edges from mentions that stand close together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencegraph import vocab
from fencegraph.config import with_knobs
from fencegraph.functions import keys
from fencegraph.functions import text as X
from fencegraph.functions.ranking import number_rows

WINDOW = 250
EVIDENCE_PAD = 30


def band_pairs(mentions: DataFrame, window: int | Column = WINDOW, scope: tuple[str, ...] = ("work_id", "chapter_ordinal")) -> DataFrame:
    """Ordered mention pairs of different nodes with ``b.start - a.end <= window`` inside a scope.

    A range join as an equi-join: positions fall into buckets one window wide, ``b`` has one bucket and
    ``a`` the few it can reach. A long or crowded chapter is thereby split over many keys, and only
    mentions within reach of each other ever meet. ``window`` may be 0, or a column that says how far each mention reaches.
    """
    width = max(window, 1) if isinstance(window, int) else WINDOW
    reach = F.lit(window) if isinstance(window, int) else window
    keys = list(scope)
    cols = ["mention_id", "node_id", "node_type", "char_start", "char_end", "__reach"]
    placed = mentions.filter(F.col("node_id").isNotNull()).withColumn("__reach", reach)

    def side(p: str) -> DataFrame:
        return placed.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in cols])

    a = side("a").withColumn(
        "bucket", F.explode(F.sequence(F.floor(F.col("a_char_start") / width), F.floor((F.col("a_char_end") + F.col("a___reach")) / width)))
    )
    b = side("b").drop("b___reach").withColumn("bucket", F.floor(F.col("b_char_start") / width))
    later = (F.col("b_char_start") > F.col("a_char_start")) | (
        (F.col("b_char_start") == F.col("a_char_start")) & (F.col("b_mention_id") > F.col("a_mention_id"))
    )
    near = F.col("b_char_start") - F.col("a_char_end") <= F.col("a___reach")
    return a.join(b, [*keys, "bucket"]).filter(later & near & (F.col("a_node_id") != F.col("b_node_id"))).drop("bucket", "a___reach")


def accumulate_pairs(pairs: DataFrame) -> DataFrame:
    """Per unordered node pair: count, and the first pair of its earliest chapter."""
    swap = F.col("a_node_id") > F.col("b_node_id")
    first = F.min(
        F.struct(
            F.col("chapter_ordinal").alias("chapter"), F.col("a_char_start").alias("a_start"), F.col("a_mention_id").alias("a_id"),
            F.col("b_char_start").alias("b_start"), F.col("b_mention_id").alias("b_id"),
            F.col("a_char_end").alias("a_end"), F.col("b_char_end").alias("b_end"),
            F.when(swap, F.col("b_node_type")).otherwise(F.col("a_node_type")).alias("lo_type"),
            F.when(swap, F.col("a_node_type")).otherwise(F.col("b_node_type")).alias("hi_type"),
        )
    )
    return pairs.groupBy("work_id", F.least("a_node_id", "b_node_id").alias("lo"), F.greatest("a_node_id", "b_node_id").alias("hi")).agg(
        F.count(F.lit(1)).alias("cooccurrences"), first.alias("first")
    ).select("work_id", "lo", "hi", "cooccurrences", "first.*")


def pair_evidence(pairs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Quote around both mentions of the first pair; one text lookup per pair, after the aggregation."""
    text = chapters.select("work_id", F.col("ordinal").alias("chapter"), X.blocks(F.col("clean_text")).alias("blocks"))
    lo, hi = F.least("a_start", "b_start"), F.greatest("a_end", "b_end")
    return pairs.join(text, ["work_id", "chapter"], "left").withColumn(
        "evidence", F.coalesce(X.block_snippet(F.col("blocks"), lo, hi, EVIDENCE_PAD), F.lit(""))
    ).drop("blocks")


def classify(pairs: DataFrame, cues: list[str] | None = None) -> DataFrame:
    """Relation and direction from the type-pair rules; a leadership cue in the quote promotes membership.

    The cue test is a substring test, so "led" also fires inside longer words.
    """
    rules = {f"{s}>{t}": r for (s, t), r in vocab.TYPE_PAIR_RELATION.items()}
    ahead = vocab.lookup(rules, F.concat_ws(">", "lo_type", "hi_type"))
    back = vocab.lookup(rules, F.concat_ws(">", "hi_type", "lo_type"))
    cue = F.lower("evidence").rlike("|".join(cues or vocab.LEADER_CUES))
    r = pairs.withColumn("__a", ahead).withColumn("__b", back)
    rel = F.coalesce("__a", "__b", F.lit("RelatedTo"))
    turned = F.col("__a").isNull() & F.col("__b").isNotNull()
    return (
        r.withColumn("relation", F.when((rel == "MemberOf") & cue, F.lit("LeaderOf")).otherwise(rel))
        .withColumn("source_id", F.when(turned, F.col("hi")).otherwise(F.col("lo")))
        .withColumn("target_id", F.when(turned, F.col("lo")).otherwise(F.col("hi")))
        .drop("__a", "__b")
    )


def edge_ids(edges: DataFrame, tier: int, order: list[Column]) -> DataFrame:
    """Edge ids that follow the order of first appearance; numbered per first chapter (bounded by its text)."""
    n = number_rows(edges, ["work_id"], F.col("first_seen_chapter"), order, "no")
    return n.withColumn("edge_id", keys.edge_id(F.col("work_id"), tier, F.col("no"))).drop("no")


def build_structural(linked: DataFrame, chapters: DataFrame, *, window: int = WINDOW, min_cooccurrences: int = 1, knobs: DataFrame | None = None) -> DataFrame:
    """Tier 1 edges of linked mentions (they carry node_id and node_type). ``knobs``: window and least count of each work."""
    if knobs is None:
        pairs = accumulate_pairs(band_pairs(linked, window)).filter(F.col("cooccurrences") >= min_cooccurrences)
    else:
        pairs = accumulate_pairs(band_pairs(with_knobs(linked, knobs), F.col("window_chars")))
        pairs = with_knobs(pairs, knobs).filter(F.col("cooccurrences") >= F.col("min_cooccurrences")).select(*pairs.columns)
    e = classify(pair_evidence(pairs, chapters)).withColumn("first_seen_chapter", F.col("chapter"))
    e = edge_ids(e, 1, [F.col(c) for c in ("a_start", "a_id", "b_start", "b_id")])
    return e.select(
        "work_id", "edge_id", "source_id", "target_id", "relation", F.lit(1).alias("tier"), "first_seen_chapter",
        F.col("first_seen_chapter").alias("revealed_chapter"), F.lit("rule").alias("method"), "evidence",
    )


def relation_report(edges: DataFrame) -> DataFrame:
    return edges.groupBy("work_id", "relation").agg(F.count(F.lit(1)).alias("edges"))
