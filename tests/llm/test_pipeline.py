import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fencegraph.llm import bpe, langid, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus in two made-up languages with planted copies, leaks and secrets."""
    rng = random.Random(11)
    syllables = {"aa": ["ba", "ko", "ri", "tu"], "bb": ["xy", "zw", "qe", "vj"]}
    say = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(2, 5))) for _ in range(n))
    items = [(i, say("aa", 20)) for i in range(3)]
    docs = [(i, say("aa" if i % 2 else "bb", 60), "aa" if i % 2 else "bb", "s", 0) for i in range(300)]
    docs += [(1001, docs[1][1], "aa", "s", 0), (1002, docs[2][1], "bb", "s", 0)]  # copies
    docs += [(1010, say("aa", 50) + " " + items[0][1] + " " + say("aa", 50), "aa", "s", 0)]  # a leak
    docs += [(1020, say("bb", 40) + " password=hunter2222 " + say("bb", 40), "bb", "s", 0)]
    docs += [(1030, None, "aa", "s", 0), (1031, "", "aa", None, 0), (1032, "123 456 !!", None, "s", 0), (None, say("aa", 60), "aa", "s", 0), (1020, docs[1][1], "aa", "s", 0)]
    docs += [(1040, say("aa", 20000), "aa", "s", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs


def test_every_decision_takes_effect(spark, folder):
    path, docs = folder
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    texts = dict((d[0], d[1]) for d in docs[:300]) | {1040: docs[-1][1], None: docs[-3][1]}
    assert set(out) == set(texts) | {1020}
    c = bpe.codec(*corpus_pipeline.TOKENIZER)
    for i, t in texts.items():
        assert c.decode(list(out[i].ids)) == t.encode() and out[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert out[i].n_tokens == len(out[i].ids) and list(out[i].ids) == c.library.encode_ordinary(t)
    masked = c.decode(list(out[1020].ids)).decode()
    assert "[SECRET]" in masked and "hunter" not in masked


def test_stages_return_the_columns_of_documents(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.where("false"), path).collect() == []


def test_ids_are_decoded_in_a_stage_of_their_own(spark, folder):
    path, _ = folder
    plan = corpus_pipeline.token_ids(spark, spark.read.parquet(f"{path}/documents.parquet"), path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # each one more is a Python process more per core


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(0)
    p = [rng.normal(0, 0.2, (2, langid.PAD + 1, 3)) for _ in range(3)] + [rng.normal(0, 0.4, (2, 3, 3)) for _ in range(3)] + [rng.normal(0, 0.4, (2, 3, 2)), rng.normal(0, 0.1, 2)]
    p[0] += 0.5
    p[1] += 0.5
    codes, y = rng.integers(0, 6, (7, 4)), np.array([0, 1, 1, 0])
    codes[5:, 2] = langid.PAD

    def loss():
        net = langid.Network(("x", "y"), tuple(p[:3]), tuple(p[3:6]), p[6], p[7])
        h = langid.states(net, codes).astype(float)
        prob = langid._softmax(h[0] @ p[6][0] + h[1] @ p[6][1] + p[7])
        real = codes != langid.PAD
        return -(np.log(prob[:, np.arange(4), y]) * real).sum() / real.sum()

    grads = langid._gradients(p, codes, y)
    for a, g in zip(p, grads):
        for at in [tuple(rng.integers(0, s) for s in a.shape) for _ in range(6)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            kept = a[at]
            a[at] = kept + 1e-2
            up = loss()
            a[at] = kept - 1e-2
            down = loss()
            a[at] = kept
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3


def test_languages_are_told_and_windows_meet(spark, folder, monkeypatch):
    path, docs = folder
    net = langid.fit(spark.read.parquet(f"{path}/documents.parquet"), "text", "lang", F.xxhash64("doc_id"))
    got = langid.predict(spark.createDataFrame([(*d[:2], "x", 0.5) for d in docs], "doc_id long, text string, lang_pred string, score double"), "text", net).collect()
    assert len(got) == len(docs)
    by_text = {d[1]: d[2] for d in docs}
    for r in got:
        assert r.lang_pred == ("und" if not any(c.isalpha() for c in r.text or "") else by_text[r.text]) and 0 <= r.score <= 1
    long = [t.encode() for _, t, *_ in docs[:6]] + [b"", docs[-1][1].encode()]
    whole = langid.document_probabilities(net, long)
    monkeypatch.setattr(langid, "LANES", 3)
    assert abs(langid.document_probabilities(net, long) - whole).max() < 1e-4
    monkeypatch.setattr(langid, "CORE", 100)
    assert abs(langid.document_probabilities(net, long) - whole).max() < 0.02


CLASHING = "fp base added cand __text __kept __n __t __spans __parts __lang_pred __lang_score __leaks lang_pred lang_score leaks mark id kept nth words score c0 c1 node component_id component first text_ __bytes m bound l o t y row n_words item_id stop ids".split()


def test_further_columns_of_any_name_stay(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id > 280 OR doc_id IS NULL OR doc_id < 4")
    wide = docs.select(F.create_map(F.lit("a"), F.lit(1)).alias("a_map"), *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)], *docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, path)
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert all(r["a_map"] == {"a": 1} and [r[c] for c in CLASHING] == [f"x{i}" for i in range(len(CLASHING))] for r in rows), name
        key = lambda r: tuple(str(r[c]) for c in docs.columns)
        assert sorted(map(key, rows)) == sorted(map(key, stage(spark, docs, path).collect())), name
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted((str(r.doc_id), r.n_tokens) for r in last(spark, wide, path).collect()) == sorted((str(r.doc_id), r.n_tokens) for r in last(spark, docs, path).collect())


@pytest.mark.parametrize("rows", [[], [(1, "some text", None, "s", 9), (None, None, None, None, None), (2, None, "en", None, 0)]])
def test_empty_tables_and_tables_without_labels(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    got = {tuple(r) for r in queries.QUERIES["op10_language_id"](spark, str(tmp_path)).collect()}
    assert got == {(r[0], bool(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0), "und", 0.0) for r in rows}


def test_of_rows_with_one_id_the_same_one_stays(spark, folder):
    path, docs = folder
    rows = [(7, docs[1][1], lang, source, n) for lang, source, n in [("aa", "s", 1), ("aa", "s", 2), ("bb", None, 1), (None, "s", 1)]] * 3
    one = lambda rs: [tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rs, COLUMNS), path).collect()]
    assert one(rows) == one(rows[::-1]) and len(one(rows)) == 1
