"""Scores against gold labels, threshold sweeps and reveal-timing verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencegraph import vocab
from fencegraph.operators.social import canonical_direction

THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_scores(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 from tp, fp, fn; 0 where a denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    c = counts.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
    return c.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _matched(gold: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = gold.select(*keys).distinct().withColumn("__g", F.lit(True))
    p = pred.select(*keys).distinct().withColumn("__p", F.lit(True))
    j = g.join(p, list(keys), "full_outer")
    return j.select(*keys, F.col("__g").isNotNull().alias("g"), F.col("__p").isNotNull().alias("p"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(~F.col("g") & F.col("p")).alias("fp"), F.count_if(F.col("g") & ~F.col("p")).alias("fn")]


def prf1(gold: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set precision, recall and F1: one row."""
    return with_scores(_matched(gold, pred, keys).agg(*_counts()))


def prf1_by(gold: DataFrame, pred: DataFrame, keys: Sequence[str], by: str, total: str = "ALL") -> DataFrame:
    """Scores per value of ``by`` (one of the keys) and a row over everything."""
    m = _matched(gold, pred, keys)
    return with_scores(m.groupingSets([[by], []], by).agg(*_counts())).withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit(total)))


def normal_triples(df: DataFrame) -> DataFrame:
    """(source, relation, target) with inverse relations folded and symmetric ones ordered."""
    back = F.col("relation").isin(list(vocab.INVERSE_RELATIONS))
    t = df.withColumn("source_id", F.when(back, F.col("target")).otherwise(F.col("source"))).withColumn(
        "target_id", F.when(back, F.col("source")).otherwise(F.col("target"))
    ).withColumn("relation", F.coalesce(vocab.lookup(vocab.INVERSE_RELATIONS, F.col("relation")), F.col("relation")))
    return canonical_direction(t).withColumn("source", F.col("source_id")).withColumn("target", F.col("target_id")).drop("source_id", "target_id")


def resolve_triples(pred: DataFrame, aliases: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Predicted edges by name -> gold names; ends off the gold list drop out. ``aliases``: keys, norm, canonical."""
    ks = list(keys)
    s = aliases.select(*ks, F.col("norm").alias("source_norm"), F.col("canonical").alias("source"))
    t = aliases.select(*ks, F.col("norm").alias("target_norm"), F.col("canonical").alias("target"))
    j = pred.join(s, [*ks, "source_norm"]).join(t, [*ks, "target_norm"]).filter("source <> target")
    return normal_triples(j.select(*ks, "source", "relation", "target")).distinct()


def pair_coverage(gold: DataFrame, pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many gold pairs the other system connects by any relation."""
    pair = [F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")]
    g = gold.select(*keys, *pair).distinct()
    p = pred.select(*keys, *pair).distinct().withColumn("__c", F.lit(True))
    return g.join(p, [*keys, "lo", "hi"], "left").agg(F.count(F.lit(1)).alias("gold_pairs"), F.count_if(F.col("__c").isNotNull()).alias("covered"))


def threshold_sweep(gold: DataFrame, scored: DataFrame, keys: Sequence[str], score: str = "score", thresholds: Sequence[float] = THRESHOLDS, by: Sequence[str] = ()) -> DataFrame:
    """Scores at every threshold, of the whole or of each value of the keys ``by``, from one scored table: a candidate's best score
    decides where it counts."""
    best = scored.groupBy(*keys).agg(F.max(score).alias("s"))
    m = gold.select(*keys).distinct().withColumn("g", F.lit(True)).join(best, list(keys), "full_outer")
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    x = m.select(*by, F.coalesce("g", F.lit(False)).alias("g"), "s", F.explode(levels).alias("threshold"))
    x = x.withColumn("p", F.coalesce(F.col("s") >= F.col("threshold"), F.lit(False)))
    return with_scores(x.groupBy(*by, "threshold").agg(*_counts()))


def timing_verdict(first_yes: Column, gold: Column) -> Column:
    """EXACT, EARLY, LATE, MISS; controls (null gold) PASS or FAIL."""
    control = F.when(first_yes.isNotNull(), "FAIL").otherwise("PASS")
    return (
        F.when(gold.isNull(), control).when(first_yes.isNull(), "MISS").when(first_yes == gold, "EXACT")
        .when(first_yes < gold, "EARLY").otherwise("LATE")
    )


def timing_report(targets: DataFrame, confirmed: DataFrame, last: DataFrame, *, any_relation: bool = False) -> DataFrame:
    """Verdict per target (work_id, name_a, name_b, relation, gold) from yes verdicts (.., k), swept to gold + 1.

    ``any_relation`` asks when the pair is first held to be one identity at all; its gold is the earliest
    of the pair's targets, and only ``cited`` is asked of the verdict.
    """
    pair = ["work_id", "name_a", "name_b"]
    t = targets
    if any_relation:
        t = targets.groupBy(*pair).agg(F.min("gold").alias("gold")).withColumn("relation", F.lit(None).cast("string"))
    t = t.join(last, "work_id").withColumn("ceiling", F.coalesce(F.least("last", F.col("gold") + 1), F.col("last")))
    yes = confirmed.select(*pair, F.col("relation").alias("said"), "k")
    fits = F.col("relation").isNull() | (F.col("relation") == F.col("said"))
    hit = F.when(fits & (F.col("k") <= F.col("ceiling")), F.col("k"))
    return t.join(yes, pair, "left").groupBy(*pair, "relation", "gold").agg(F.min(hit).alias("first_yes")).withColumn(
        "verdict", timing_verdict(F.col("first_yes"), F.col("gold"))
    )


def grade_groups(reply: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """(json_ok, pair asserted) of a reply ``{"same_entity": [[names], {"names": [names]}]}``."""
    ok = F.try_parse_json(reply).isNotNull()
    groups = F.from_json(F.get_json_object(reply, "$.same_entity"), "array<string>")
    names = F.transform(groups, lambda g: F.from_json(F.when(g.startswith("{"), F.get_json_object(g, "$.names")).otherwise(g), "array<string>"))
    low = F.transform(names, lambda g: F.transform(g, lambda n: F.lower(F.trim(n))))
    hit = F.exists(low, lambda g: F.exists(g, lambda n: F.contains(n, a)) & F.exists(g, lambda n: F.contains(n, b)))
    return ok, ok & F.coalesce(hit, F.lit(False))
