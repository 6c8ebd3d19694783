import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from fencegraph.llm import langid


def test_every_label_is_learnt_from_whole_texts(spark):
    rng = random.Random(10)
    header = "the same licence stands before every text " * 40  # more than the characters learnt of a text
    words = {f"l{i:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(4)] for i in range(70)}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    docs = [(lang, header + say(lang, 2000)) for lang in words for _ in range(4 + (lang < "l60"))]
    net = langid.fit(spark.createDataFrame(docs, "lang string, text string"), "text", "lang", F.xxhash64("text"))
    assert net.languages == tuple(sorted(words))
    seen = spark.createDataFrame([(lang, say(lang, 120)) for lang in words], "lang string, text string")
    got = langid.predict(seen, "text", net).collect()
    assert sum(r.lang_pred == r.lang and r.score >= 0.4 for r in got) >= 68


def test_a_sample_does_not_grow_with_the_copies_of_a_row(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(langid, "train", lambda texts, y, names, **how: taken.append((len(texts), names)))
    rows = spark.range(40_000).select(F.when(F.col("id") < 20_000, 0).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 4 == 0, "bb").otherwise("aa").alias("lang"), F.when(F.col("id") < 20_000, "copy").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    langid.fit(rows, "text", "lang", F.xxhash64("id"), per_language=100)
    assert taken == [(200, ("aa", "bb"))]


def test_a_sample_needs_no_python_on_executors(spark, monkeypatch):
    plans, top_rows = [], langid.top_rows
    monkeypatch.setattr(langid, "train", lambda texts, y, names, **how: sorted(zip(texts, y)))
    monkeypatch.setattr(langid, "top_rows", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or top_rows(df, *a))
    got = langid.fit(spark.createDataFrame([("b", "y"), ("a", "x"), ("'\u00e9\"", "z"), ("a", None), (None, "w")], "lang string, text string"), "text", "lang", F.xxhash64("text"))
    assert got == [(b"x", 1), (b"y", 2), (b"z", 0)]
    assert "bound" in plans[0] and plans[0].count("ExistingRDD") == 1  # the documents made here


def test_without_labels_no_language_is_known(spark):
    df = spark.createDataFrame([(1, "text", None), (None, None, "en"), (3, "12", "en")], "doc_id long, text string, lang string")
    for docs in (df, df.where("false")):
        net = langid.fit(docs, "text", "lang", F.xxhash64("doc_id"))
        assert net.languages == () and {(r.lang_pred, r.score) for r in langid.predict(docs, "text", net).collect()} <= {("und", 0.0)}


def test_a_block_is_labelled_without_keeping_its_states():
    rng = np.random.default_rng(3)
    weights = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    net = langid.Network(tuple("abcd"), tuple(weights(2, 257, 8) for _ in range(3)), tuple(weights(2, 8, 8) for _ in range(3)), weights(2, 8, 4), weights(4))
    codes = rng.integers(0, 256, (langid.CORE + 2 * langid.WARM, langid.LANES)).astype(np.int16)
    tracemalloc.start()
    got = langid.position_probabilities(net, codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    h = langid.states(net, codes)
    logits = np.exp(h[0] @ net.output[0] + h[1] @ net.output[1] + net.bias)
    np.testing.assert_allclose(got, logits / logits.sum(axis=-1, keepdims=True), atol=1e-5)
    assert peak < h.nbytes
