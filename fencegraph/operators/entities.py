"""Mentions to typed nodes: tagging, numbering, name clustering, node materialisation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fencegraph import vocab
from fencegraph.functions import keys
from fencegraph.functions import text as X
from fencegraph.functions.grams import lexicon_grams, sieve
from fencegraph.functions.lineage import cut
from fencegraph.functions.ranking import number_by_position, number_rows

DEFAULT_THRESHOLD = 0.4
EVIDENCE_PAD = 40


def tag_gazetteer(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Candidate spans: word n-grams of every chunk that equal a lexicon entry.

    ``chunks`` needs work_id, chapter_ordinal, ordinal, text; ``lexicon`` needs norm, label. The n-grams are those of
    the lengths its entries have, and one word more, as a leading article is no part of an entry. Those that a sieve of the entries lets
    through, nearly all of them entries, come with their surface and meet the lexicon; that join is left to Catalyst: it
    broadcasts only if the measured size allows. Chunks without a key give nothing, and each of several chunks under one key is read at
    the places found in any of them.
    """
    key = ["work_id", "chapter_ordinal", "ordinal"]
    own = {r[0] for r in lexicon.select(F.size(F.split("norm", " "))).distinct().collect()}  # lengths, not entries
    lengths = sorted(own | {n + 1 for n in own}) or [1]
    keyed = chunks.select(*key, "text").dropna(subset=key)
    hits = lexicon_grams(keyed, key, sieve(lexicon), lengths).join(lexicon.select("norm", "label"), "norm")
    again = cut(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key), "again")
    if not again.isEmpty():
        shared = hits.join(again, key, "left_semi").join(keyed.select(*key, X.blocks(F.col("text")).alias("blocks")), key)
        shared = shared.withColumn("surface", X.block_slice(F.col("blocks"), F.col("s"), F.col("e"))).drop("blocks")
        hits = hits.join(again, key, "left_anti").unionByName(shared)
    return hits.select(
        "work_id", "chapter_ordinal", F.col("ordinal").alias("chunk_ordinal"), "surface",
        "label", F.lit(None).cast("string").alias("subtype"), F.col("s").alias("char_start"), F.col("e").alias("char_end"), F.lit(1.0).alias("score"),
    )


def label_types(extra: Mapping[str, str] | None = None) -> dict[str, str]:
    """Label map with per-work extra labels; an unknown node type is an error."""
    wrong = sorted({t for t in (extra or {}).values() if t not in vocab.NODE_TYPES})
    if wrong:
        raise ValueError(f"unknown node types in extra labels: {wrong}")
    return {**vocab.LABEL_TYPES, **(extra or {})}


def map_labels(spans: DataFrame, extra: Mapping[str, str] | None = None) -> DataFrame:
    """Label -> one of the eight types; spans with other labels are dropped."""
    return spans.withColumn("type", vocab.lookup(label_types(extra), F.col("label"))).filter(F.col("type").isNotNull())


def keep_scored(spans: DataFrame, threshold: Column | float = DEFAULT_THRESHOLD) -> DataFrame:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return spans.filter(F.col("score") >= F.coalesce(t, F.lit(DEFAULT_THRESHOLD)))


def rebase_spans(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk offsets to chapter offsets; one row per (start, end, type): best score, earliest chunk on ties."""
    base = chunks.select("work_id", "chapter_ordinal", F.col("ordinal").alias("chunk_ordinal"), F.col("char_start").alias("base"))
    at = spans.join(base, ["work_id", "chapter_ordinal", "chunk_ordinal"]).withColumn(
        "char_start", F.col("char_start") + F.col("base")
    ).withColumn("char_end", F.col("char_end") + F.col("base"))
    best = F.max_by(F.struct("surface", "score", "subtype", "chunk_ordinal"), F.struct("score", -F.col("chunk_ordinal")))
    return at.groupBy("work_id", "chapter_ordinal", "char_start", "char_end", "type").agg(best.alias("b")).select(
        "work_id", "chapter_ordinal", "b.surface", "type", "b.subtype", "char_start", "char_end", "b.score", "b.chunk_ordinal"
    )


def number_mentions(spans: DataFrame) -> DataFrame:
    """Mention ordinal by (start, end) inside its chapter (bounded by the text of one chapter)."""
    w = Window.partitionBy("work_id", "chapter_ordinal").orderBy("char_start", "char_end", "type")
    m = spans.withColumn("ordinal", F.row_number().over(w) - 1)
    return m.withColumn("mention_id", keys.in_work(F.col("chapter_ordinal"), F.col("ordinal"))).withColumn("method", F.lit("gliner"))


def names(mentions: DataFrame) -> DataFrame:
    """One row per (work, normal form): majority type (first met wins ties), members, first position."""
    m = mentions.withColumn("norm", X.normalize_surface(F.col("surface"))).filter(F.col("norm") != "")
    votes = m.groupBy("work_id", "norm", "type").agg(F.count(F.lit(1)).alias("n"), F.min("mention_id").alias("at"))
    return votes.groupBy("work_id", "norm").agg(
        F.max_by("type", F.struct("n", -F.col("at"))).alias("type"), F.sum("n").alias("members"), F.min("at").alias("first_pos")
    ).withColumn("tokens", F.array_distinct(F.split("norm", " ")))


def fold_names(named: DataFrame) -> DataFrame:
    """Host of every name: the best maximal same-type name whose tokens strictly contain its tokens, else itself.

    A name of one token meets its hosts on that token; a longer one on its two rarest tokens, so a
    frequent token alone never pairs all names that carry it. Names made of generic tokens stay.
    """
    generic = F.array(*[F.lit(t) for t in vocab.GENERIC_NAME_TOKENS])
    rows = named.select("work_id", "type", "norm", "tokens", "members", "first_pos", F.size("tokens").alias("n_tokens"))
    tok = rows.select("work_id", "type", "norm", F.explode("tokens").alias("token"))
    freq = tok.groupBy("work_id", "type", "token").agg(F.count(F.lit(1)).alias("df"))
    foldable = rows.filter(F.size(F.array_except("tokens", generic)) > 0)
    rare = (
        tok.join(foldable.select("work_id", "type", "norm"), ["work_id", "type", "norm"])
        .join(freq, ["work_id", "type", "token"])
        .groupBy("work_id", "type", "norm")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("by_df"))  # a handful of tokens per name
    )
    key = F.when(F.size("by_df") == 1, F.col("by_df")[0]["token"]).otherwise(
        F.array_join(F.sort_array(F.array(F.col("by_df")[0]["token"], F.col("by_df")[1]["token"])), "\n")
    )
    probes = rare.select("work_id", "type", "norm", key.alias("probe")).join(
        rows.select("work_id", "type", "norm", "tokens", "n_tokens"), ["work_id", "type", "norm"]
    )
    sorted_tokens = F.sort_array("tokens")
    pair_keys = F.flatten(
        F.transform(
            sorted_tokens,
            lambda a: F.transform(F.filter(sorted_tokens, lambda b: b > a), lambda b: F.concat(a, F.lit("\n"), b)),
        )
    )
    hosts = rows.filter("n_tokens > 1").select(
        "work_id", "type", F.col("norm").alias("host"), F.col("tokens").alias("h_tokens"), F.col("n_tokens").alias("h_n"),
        F.col("members").alias("h_members"), F.col("first_pos").alias("h_pos"), F.explode(F.concat("tokens", pair_keys)).alias("probe"),
    )
    inside = probes.join(hosts, ["work_id", "type", "probe"]).filter(
        (F.col("n_tokens") < F.col("h_n")) & (F.size(F.array_except("tokens", "h_tokens")) == 0)
    )
    folded = inside.select("work_id", "norm").distinct()
    maximal = inside.join(
        folded.withColumnRenamed("norm", "host"), ["work_id", "host"], "left_anti"
    )
    best = maximal.groupBy("work_id", "norm").agg(
        F.max_by("host", F.struct("h_n", "h_members", -F.col("h_pos"))).alias("host")
    )
    return rows.join(best, ["work_id", "norm"], "left").withColumn("host", F.coalesce("host", "norm"))


def entity_clusters(mentions: DataFrame, folds: DataFrame) -> DataFrame:
    """One row per entity: canonical name, counts, first chapter, first subtype, evidence position.

    Surfaces are counted first and entities second, so the protagonist's mentions
    are combined inside the map tasks.
    """
    m = mentions.withColumn("norm", X.normalize_surface(F.col("surface"))).filter(F.col("norm") != "")
    own = folds.filter(F.col("norm") == F.col("host")).select(
        "work_id", "host", F.col("type").alias("host_type"), F.struct(F.col("n_tokens").alias("a"), F.col("members").alias("b"), (-F.col("first_pos")).alias("c")).alias("rank")
    )
    link = folds.select("work_id", "norm", "host", F.struct(F.col("n_tokens").alias("a"), F.col("members").alias("b"), (-F.col("first_pos")).alias("c")).alias("seq"))
    per_surface = (
        m.withColumn("surface", X.strip_ws(F.col("surface")))
        .groupBy("work_id", "norm", "surface")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("mention_id").alias("at"),
            F.min("chapter_ordinal").alias("first_seen"),
            F.min(F.when(F.col("subtype").isNotNull(), F.struct("mention_id", "subtype"))).alias("sub"),
            F.min(F.struct("chapter_ordinal", "char_start", "mention_id", "char_end")).alias("ev"),
        )
        .join(link, ["work_id", "norm"])
    )
    s = per_surface.groupBy("work_id", "host", "surface").agg(  # one surface has one norm
        F.sum("n").alias("n"), F.max(F.struct("seq", (-F.col("at")).alias("at"))).alias("met"), F.min("first_seen").alias("first_seen"),
        F.max(F.when(F.col("sub").isNotNull(), F.struct("seq", (-F.col("sub.mention_id")).alias("at"), F.col("sub.subtype").alias("v")))).alias("sub"),
        F.min(F.struct(F.col("ev.chapter_ordinal").alias("ch"), F.col("ev.char_start").alias("s"), F.struct((-F.col("seq.a")).alias("a"), (-F.col("seq.b")).alias("b"), (-F.col("seq.c")).alias("c")).alias("seq"), F.col("ev.mention_id").alias("id"), F.col("ev.char_end").alias("e"))).alias("ev"),
    )
    c = s.groupBy("work_id", "host").agg(
        F.max_by("surface", F.struct("n", F.length("surface"), "met")).alias("name"),
        F.min("first_seen").alias("first_seen_chapter"), F.sum("n").alias("mention_count"), F.max("sub").alias("sub"), F.min("ev").alias("ev"),
    )
    return c.join(own, ["work_id", "host"]).select(
        "work_id", "host", F.col("host_type").alias("type"), "name", F.col("sub.v").alias("subtype"), "first_seen_chapter", "mention_count",
        F.col("ev.ch").alias("ev_chapter"), F.col("ev.s").alias("ev_start"), F.col("ev.e").alias("ev_end"), "rank",
    )


def build_nodes(clusters: DataFrame, chapters: DataFrame | None) -> DataFrame:
    """Nodes in listing order (first chapter, most mentioned, name), with the evidence quote.

    Rows are numbered per first chapter, which the text of one chapter bounds.
    """
    order = [F.desc("mention_count"), F.col("name"), F.desc("rank")]
    n = number_rows(clusters, ["work_id"], F.col("first_seen_chapter"), order, "no")
    if chapters is not None:
        text = chapters.select("work_id", F.col("ordinal").alias("ev_chapter"), X.blocks(F.col("clean_text")).alias("blocks"))
        n = n.join(text, ["work_id", "ev_chapter"], "left").withColumn(
            "evidence", F.coalesce(X.block_snippet(F.col("blocks"), F.col("ev_start"), F.col("ev_end"), EVIDENCE_PAD), F.lit(""))
        )
    else:
        n = n.withColumn("evidence", F.lit(None).cast("string"))
    return n.select(
        "work_id", keys.node_id(F.col("work_id"), F.col("no")).alias("node_id"), "type", "name", "subtype",
        F.col("mention_count").cast("double").alias("importance"), "first_seen_chapter",
        F.col("first_seen_chapter").alias("revealed_chapter"), F.lit("gliner").alias("method"), "evidence", F.col("host").alias("norm"),
    )


def link_mentions(mentions: DataFrame, folds: DataFrame, nodes: DataFrame) -> DataFrame:
    """Back-fill ``node_id`` (and the node's type) by join; names that normalise to nothing keep null."""
    to_node = folds.select("work_id", "norm", "host").join(
        nodes.select("work_id", F.col("norm").alias("host"), "node_id", F.col("type").alias("node_type")), ["work_id", "host"]
    ).drop("host")
    m = mentions.drop("node_id").withColumn("norm", X.normalize_surface(F.col("surface")))
    return m.join(to_node, ["work_id", "norm"], "left").drop("norm")


def keep_ids(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Nodes under the ids that ``known`` (work_id, type, norm, node_id) has for them; others get the numbers after the work's last
    one, in the order of the nodes."""
    kept = known.select("work_id", "type", "norm", F.col("node_id").alias("__kept"))
    last = known.groupBy("work_id").agg((F.max("node_id") - F.col("work_id") * keys.NODES).alias("__last"))
    met = nodes.join(kept, ["work_id", "type", "norm"], "left")
    new = number_by_position(met.filter(F.col("__kept").isNull()).withColumn("__no", F.col("node_id") - F.col("work_id") * keys.NODES), ["work_id"], "__no", "__nth")
    new = new.join(last, "work_id", "left").withColumn("node_id", keys.node_id(F.col("work_id"), F.coalesce("__last", F.lit(0)) + F.col("__nth")))
    return met.filter(F.col("__kept").isNotNull()).withColumn("node_id", F.col("__kept")).select(*nodes.columns).unionByName(new.select(*nodes.columns))


def resolve(mentions: DataFrame, chapters: DataFrame | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Mentions -> (nodes, mentions with node_id). The name tables are written once: each is read many times. Nodes keep the
    ids of ``known``."""
    folds = cut(fold_names(cut(names(mentions), "names")), "folds")
    nodes = cut(build_nodes(cut(entity_clusters(mentions, folds), "clusters"), chapters), "nodes")
    if known is not None:
        nodes = cut(keep_ids(nodes, known), "nodes")
    return nodes, link_mentions(mentions, folds, nodes)


def extraction_report(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entities per (work, type) and per work, with the work's mention count."""
    m = mentions.groupBy("work_id").agg(F.count(F.lit(1)).alias("mentions"))
    n = nodes.groupingSets([["work_id"], ["work_id", "type"]], "work_id", "type").agg(F.count(F.lit(1)).alias("entities"))
    return n.join(m, "work_id").select("work_id", F.coalesce("type", F.lit("ALL")).alias("type"), "entities", "mentions")
