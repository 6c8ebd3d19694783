"""Tier 2: social relation spans anchored to nodes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencegraph import vocab
from fencegraph.functions import text as X
from fencegraph.functions.arrays import bind
from fencegraph.functions.lineage import cut
from fencegraph.operators.relations import EVIDENCE_PAD, band_pairs, edge_ids


def cue_spans(chunk_mentions: DataFrame, chunks: DataFrame, phrases: Mapping[str, str] | None = None, window: int = 250) -> DataFrame:
    """Relation spans from phrases that stand between two mentions of a chunk.

    ``chunk_mentions``: work_id, chapter_ordinal, chunk_ordinal, mention_id, node_id, node_type, char_start,
    char_end (inside the chunk), surface. Every phrase found in the gap gives one span; its score falls
    with the length of the gap. Model output of the same shape can take this place.
    """
    table = dict(phrases or vocab.RELATION_PHRASES)
    pairs = band_pairs(chunk_mentions, window, scope=("work_id", "chapter_ordinal", "chunk_ordinal")).filter("b_char_start >= a_char_end")
    text = chunks.select("work_id", "chapter_ordinal", F.col("ordinal").alias("chunk_ordinal"), X.blocks(F.col("text")).alias("blocks"))
    at = pairs.join(text, ["work_id", "chapter_ordinal", "chunk_ordinal"])
    # one slice of the text per pair, short as the window is, serves all that is asked of it
    base, end = F.greatest(F.col("a_char_start") - EVIDENCE_PAD, F.lit(0)), F.greatest("a_char_end", "b_char_end")
    near = at.select(*pairs.columns, base.alias("base"), end.alias("end"), X.block_slice(F.col("blocks"), base, end + EVIDENCE_PAD).alias("near"))
    part = lambda s, e: F.substring(F.col("near"), F.col(s) - F.col("base") + 1, F.col(e) - F.col(s))
    known = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(r).alias("relation")) for p, r in table.items()])
    near = near.withColumn("gap", F.lower(part("a_char_end", "b_char_start")))
    told = near.withColumn("hits", bind(F.col("gap"), lambda g: F.filter(known, lambda k: F.contains(g, k["phrase"])))).filter(F.size("hits") > 0)
    told = told.select(
        "work_id", "chapter_ordinal", "chunk_ordinal", "a_char_start", "a_mention_id", "b_char_start", "b_mention_id", "hits",
        part("a_char_start", "a_char_end").alias("source_surface"), part("b_char_start", "b_char_end").alias("target_surface"),
        (F.lit(1.0) / (F.lit(1) + F.length("gap"))).alias("score"), X.squeeze(F.col("near")).alias("evidence"),
    )
    hits = told.withColumn("hit", F.explode("hits"))
    return hits.select(
        "work_id", "chapter_ordinal", "chunk_ordinal",
        F.struct("a_char_start", "a_mention_id", "b_char_start", "b_mention_id", F.col("hit.phrase")).alias("pos"),
        "source_surface", F.col("hit.phrase").alias("phrase"), F.col("hit.relation").alias("relation"), "target_surface", "score", "evidence",
    )


def map_phrases(spans: DataFrame, phrases: Mapping[str, str] | None = None) -> DataFrame:
    """Phrase -> relation; unknown phrases are dropped."""
    rel = vocab.lookup(dict(phrases or vocab.RELATION_PHRASES), F.col("phrase"))
    return spans.withColumn("relation", rel).filter(F.col("relation").isNotNull())


def surface_index(nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Normal form -> the node it most often names; node names vote first, then mentions in order."""
    own = nodes.select("work_id", X.normalize_surface(F.col("name")).alias("norm"), "node_id", F.lit(0).alias("round"), F.col("node_id").alias("at"))
    said = mentions.filter(F.col("node_id").isNotNull()).select(
        "work_id", X.normalize_surface(F.col("surface")).alias("norm"), "node_id", F.lit(1).alias("round"), F.col("mention_id").alias("at")
    )
    votes = own.unionByName(said).filter("norm <> ''").groupBy("work_id", "norm", "node_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("round", "at")).alias("first")
    )
    rank = F.struct("n", (-F.col("first.round")).alias("r"), (-F.col("first.at")).alias("a"))
    return votes.groupBy("work_id", "norm").agg(F.max_by("node_id", rank).alias("node_id"))


def anchor(spans: DataFrame, index: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both ends must name a node, and not the same one; adds source_id, target_id and their types.

    Surfaces recur in many spans, so each is normalised and looked up once per work, and spans meet them as they were said.
    """
    typed = index.join(nodes.select("node_id", "type"), "node_id")
    said = spans.select("work_id", F.explode(F.array("source_surface", "target_surface")).alias("surface")).distinct()
    known = cut(said.withColumn("norm", X.normalize_surface(F.col("surface"))).join(typed, ["work_id", "norm"]).select("work_id", "surface", "node_id", "type"), "said")
    for end in ("source", "target"):
        side = known.select("work_id", F.col("surface").alias(f"{end}_surface"), F.col("node_id").alias(f"{end}_id"), F.col("type").alias(f"{end}_type"))
        spans = spans.join(side, ["work_id", f"{end}_surface"])
    return spans.filter("source_id <> target_id")


def types_valid(relation: Column, a: Column, b: Column) -> Column:
    """Kinship, romance and mentorship need two characters, every other social relation two agents."""
    people = (a == "Character") & (b == "Character")
    agents = a.isin(vocab.AGENT_TYPES) & b.isin(vocab.AGENT_TYPES)
    return F.when(relation.isin(vocab.PERSON_ONLY), people).otherwise(agents)


def split_valid(anchored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans with valid end types, distinct rejects (work_id, lo, hi, relation))."""
    ok = types_valid(F.col("relation"), F.col("source_type"), F.col("target_type"))
    rejects = anchored.filter(~ok).select("work_id", F.least("source_id", "target_id").alias("lo"), F.greatest("source_id", "target_id").alias("hi"), "relation").distinct()
    return anchored.filter(ok), rejects


def canonical_direction(spans: DataFrame) -> DataFrame:
    """Symmetric relations store the smaller id first."""
    turn = F.col("relation").isin(vocab.SYMMETRIC_SOCIAL) & (F.col("source_id") > F.col("target_id"))
    return spans.withColumn("__s", F.when(turn, F.col("target_id")).otherwise(F.col("source_id"))).withColumn(
        "target_id", F.when(turn, F.col("source_id")).otherwise(F.col("target_id"))
    ).withColumn("source_id", F.col("__s")).drop("__s")


def accumulate(spans: DataFrame) -> DataFrame:
    """Per (source, target, relation): evidence of the best positive score (first on ties) and, independently, the earliest chapter."""
    at = F.struct("chapter_ordinal", "chunk_ordinal", "pos")
    best = F.min(F.when(F.col("score") > 0, F.struct((-F.col("score")).alias("s"), at.alias("at"), F.col("evidence").alias("evidence"))))
    return spans.groupBy("work_id", "source_id", "target_id", "relation").agg(
        best.alias("b"), F.min("chapter_ordinal").alias("first_seen_chapter"), F.min(at).alias("first_at")
    ).withColumn("evidence", F.coalesce("b.evidence", F.lit(""))).drop("b")


def build_social(spans: DataFrame, nodes: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tier 2 edges, rejects) from relation spans."""
    valid, rejects = split_valid(anchor(spans, surface_index(nodes, mentions), nodes))
    e = edge_ids(accumulate(canonical_direction(valid)), 2, [F.col("first_at")])
    return e.select(
        "work_id", "edge_id", "source_id", "target_id", "relation", F.lit(2).alias("tier"), "first_seen_chapter",
        F.col("first_seen_chapter").alias("revealed_chapter"), F.lit("gliner").alias("method"), "evidence",
    ), rejects


def social_report(edges: DataFrame, rejects: DataFrame) -> DataFrame:
    """Edges per relation, and one row of rejects per work."""
    e = edges.groupBy("work_id", "relation").agg(F.count(F.lit(1)).alias("edges"))
    r = rejects.groupBy("work_id").agg(F.count(F.lit(1)).alias("edges"))
    return e.unionByName(r.select("work_id", F.lit("(rejected)").alias("relation"), "edges"))
