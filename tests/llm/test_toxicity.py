import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fencegraph.llm import sieve
from fencegraph.llm import toxicity as tox


def test_trigram_counts_equal_brute_force(spark):
    texts = ["Ab, ab!", "é x", None, "", "a" * 50, "日本 ok"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = np.zeros((tox.K,) * 3, int)
    for t in texts:
        s = [0]
        for c in (t or "") + " ":
            if not (tox.symbol(c) == 0 and s[-1] == 0):
                s.append(tox.symbol(c))
        for a, b, c in zip(s, s[1:], s[2:]):
            want[a, b, c] += 1
    assert (tox.count_trigrams(df, "text") == want).all()


def model(text):
    counts = np.zeros((tox.K,) * 3)
    s = [0, *map(tox.symbol, text + " ")]
    for a, b, c in zip(s, s[1:], s[2:]):
        counts[a, b, c] += 1
    return tox.costs_of(counts)


def test_viterbi_finds_the_cheapest_path():
    costs = model("the idiot is stupid and the boot is on the foot " * 5)

    def price(text, spent):
        a = b = 0
        for c in text + " ":
            s = tox.symbol(c)
            if s == 0 and b == 0:
                continue
            spent += costs[(a * tox.K + b) * tox.K + s]
            a, b = b, s
        return spent

    for noisy in ("1d10t", "b00t", "st*pid", "i d i o", "f0oo7", "!s", "a.b"):
        choices = tox.lattice(noisy)
        every = [("".join(t for t, _ in path), sum(c for _, c in path)) for path in itertools.product(*choices)]
        best = min(price(t, c) for t, c in every)
        got = tox.viterbi(choices, costs)
        assert any(math.isclose(price(t, c), best) and " ".join(t.split()) == got for t, c in every)


def test_disguises_are_undone_and_plain_text_stays():
    r = tox.Restorer(model("you are an idiot and a stupid loser with a well known agreeable book " * 9))
    assert r.restore("an 1d10t, $tup!d and stuuuuupid i d i o t l.o.s.e.r") == "an idiot stupid and stupid idiot loser"
    assert r.restore("A well-known, agreeable (BOOK)! 1984 ... é") == "a well known agreeable book é"
    assert r.restore("") == ""


def test_scores_of_held_out_documents(spark):
    rng = random.Random(6)
    plain = ["river", "stone", "little", "houses", "green", "window", "paper", "seven", "summer", "letter"]
    insults = ["idiot", "stupid", "loser"]
    disguise = {"idiot": "1d10t", "stupid": "$tup1d", "loser": "l o s e r"}
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(insults) if i % 2 else disguise[rng.choice(insults)]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    docs += [(5000, None, "x"), (5001, "", "x"), (5002, "river " * 100000, "x"), (None, "no id", "x"), (3, docs[3][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (7777, 1), (4, None)], "doc_id long, toxic int")
    got = tox.score(df, "doc_id", "text", lab, "doc_id", "toxic", F.col("doc_id") % 3 != 1).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.7) == (r.doc_id % 5 == 0) for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 3 == 1]
    assert sum(held) >= 0.98 * len(held)
    assert all(r.score < 0.7 for r in got if (r.doc_id or 0) >= 5000)


def test_no_labels_and_no_documents(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert [0 <= r.score <= 1 for r in tox.score(df, "doc_id", "text", lab, "doc_id", "toxic", F.lit(True)).collect()] == [True]
    assert tox.score(df.where("false"), "doc_id", "text", lab, "doc_id", "toxic", F.lit(True)).collect() == []


def test_hash_is_that_of_the_stem():
    assert tox._hash("worthless") == zlib.crc32(b"worthl") - (1 << 31)


def test_long_runs_and_words_of_signs_only_are_restored():
    r = tox.Restorer(model("you are an idiot and a stupid loser with no class at all you ass " * 9))
    long = "you are a stupid loser and an idiot " * 30
    apart = r.restore("  ".join(" ".join(w) for w in long.split()))
    assert len(apart) > 600 and apart.count("stupid") == 30 and apart.count("loser") == 30
    assert r.restore(".".join("stupid" * 20)).count("stupid") == 20
    assert r.restore("you @$$ and 455 (!) + 1984 !!!") == "you ass and ass"
    assert len(r.restore("a b " * 50_000)) > 50_000


def test_words_are_judged_whole_and_by_stem(spark):
    rng = random.Random(3)
    plain = ["river", "stone", "houses", "window", "paper", "summer"]
    docs = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(12)] + ["motherly" if i % 2 else "bookish"]
        if i % 5 == 0:
            words += ["motherfucker"] + ["assholery"] * (i % 10 == 0) + [f"worthle{i}x".translate(str.maketrans("0123456789", "abcdefghij"))]
        elif i % 40 == 1:
            words.append("worthley")
        docs.append((i, " ".join(words), int(i % 5 == 0)))
    df = spark.createDataFrame(docs, "doc_id long, text string, y int")
    costs = tox.costs_of(tox.count_trigrams(df, "text"))
    words = tox.restored_words(df, "text", costs).withColumn("row", F.monotonically_increasing_id()).cache()
    marks = tox.lexicon(words, df.select("doc_id", "y"))
    weight = {r.w: r.weight for r in marks.collect()}
    assert weight == lexicon_of({r.doc_id: list(r.words) for r in words.collect()}, {i: y for i, _, y in docs})
    assert weight[tox._key("motherfucker")] > 0 and tox._key("motherfucker") & tox.STEM_BITS not in weight
    assert weight[tox._key("worthlex") & tox.STEM_BITS] > 0 and weight[tox._key("worthley")] == 0
    seen = spark.createDataFrame([(1, "motherfucker twice motherfucker", 0), (2, "motherly", 0), (3, "worthley", 0), (4, "worthlessness", 0)], df.schema)
    rows = tox.restored_words(seen, "text", costs).withColumn("row", F.col("doc_id"))
    assert {r.row: (r.hits, r.kinds) for r in tox.marked(rows, marks).collect()} == {1: (2, 1), 4: (1, 1)}


def lexicon_of(words, y, least=5, z=6.0, ratio=4.0):
    """The rule of the lexicon, over all words in memory."""
    toxic, clean = sum(y.values()), len(y) - sum(y.values())
    counts = (Counter(), Counter())
    for d, keys in words.items():
        if d in y:
            counts[y[d]].update(set(keys) | {k & tox.STEM_BITS for k in keys})

    def judge(k):
        share = (counts[0][k] + 1) / (clean + 2)
        return counts[1][k] / toxic / share, (counts[1][k] - toxic * share) / math.sqrt(toxic * share * (1 - share))

    marks = {k: min(6.0, math.log(judge(k)[0])) for k, n in counts[1].items() if n >= least and judge(k)[0] >= ratio and judge(k)[1] >= z}
    cleared = {k: 0.0 for k in counts[0] | counts[1] if k & ~tox.STEM_BITS and marks.get(k & tox.STEM_BITS) and counts[0][k] + counts[1][k] >= least and judge(k)[0] < ratio}
    return {k: pytest.approx(w) for k, w in marks.items()} | cleared


@pytest.mark.parametrize("bits", [128, 1])
def test_documents_without_a_label_count_for_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(tox, "sieve", lambda keys, key, **how: sieve.sieve(keys, key, 15, **how) if bits > 1 else sieve.Sieve(15, b"\xff" * 4096))
    rng = random.Random(9)
    rows = [(i, " ".join(["idiot"] * (i % 4 == 0) + ["moron"] * (i % 8 == 0) + [rng.choice(["river", "stone", "paper"]) for _ in range(5)])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400, 2)], "doc_id long, y int")
    words = tox.restored_words(df, "text", tox.costs_of(tox.count_trigrams(df, "text"))).withColumn("row", F.monotonically_increasing_id()).cache()
    got = {r.w: r.weight for r in tox.lexicon(words, known).collect()}
    assert got == lexicon_of({r.doc_id: list(r.words) for r in words.collect()}, {i: int(i % 4 == 0) for i in range(0, 400, 2)}) and got
