"""Gazetteer tagging against brute force."""

import random
import re

from pyspark.sql import functions as F

from fencegraph import vocab
from fencegraph.functions import grams
from fencegraph.functions.arrays import running_starts
from fencegraph.operators import entities as E

P = vocab.OUTER_PUNCTUATION


def expected(text, lexicon):
    """(surface, label, start) of every n-gram, by words."""
    words = [(m.start(), m.group()) for m in re.finditer(r"\S+", text)]
    own = {len(n.split(" ")) for n, _ in lexicon}
    out = []
    for n in sorted(own | {k + 1 for k in own}):
        for i in range(len(words) - n + 1):
            (s, a), (z, b) = words[i], words[i + n - 1]
            if not a.strip(P) or not b.strip(P):
                continue
            s, e = s + len(a) - len(a.lstrip(P)), z + len(b.rstrip(P))
            said = text[s:e].lower().split()
            norm = " ".join(said[1:] if n > 1 and said[0] in ("the", "a", "an") else said)
            out += [(text[s:e], label, s) for entry, label in lexicon if entry == norm]
    return out


def tagged(spark, rows, lexicon):
    chunks = spark.createDataFrame(rows, "work_id long, chapter_ordinal int, ordinal int, text string")
    found = E.tag_gazetteer(chunks, spark.createDataFrame(lexicon, "norm string, label string"))
    return sorted((r.work_id, r.chapter_ordinal, r.chunk_ordinal, r.surface, r.label, r.char_start, r.char_end) for r in found.collect())


def test_grams_against_brute_force(spark):
    rng = random.Random(3)
    words = ["The", "the", "Tall", "tower", "ΣΊΣΥΦΟΣ", "İstanbul", "“Tower”", "—", "...", "(tall)", "a", "an", "𝒜x", "o'clock", "tower.", "straße"]
    blanks = [" ", " ", "  ", "\n", "\t", " ", "\x85", "\x1c"]
    lexicon = [("tower", "Place"), ("tall tower", "Place"), ("tall tower", "Item"), ("the", "x"), ("σίσυφος", "person"), ("i̇stanbul", "Place"), ("𝒜x".lower(), "y"), ("tall — tower o'clock", "z"), ("never met", "x")]
    texts = ["".join(rng.choice(["", *blanks]) if i == 0 else rng.choice(words) + rng.choice(blanks) for i in range(rng.randrange(60))) for _ in range(200)]
    rows = [(1, 1, i, t) for i, t in enumerate([*texts, "", None, " ", "tower"])]
    want = sorted((w, c, o, s, label, at, at + len(s)) for w, c, o, t in rows if t is not None for s, label, at in expected(t, lexicon))
    assert len(want) > 1000 and tagged(spark, rows, lexicon) == want


def test_chunks_without_key_or_under_one_key(spark):
    lexicon = [("tower", "Place")]
    assert tagged(spark, [(None, 1, 0, "tower"), (1, None, 0, "tower")], lexicon) == []
    twice = tagged(spark, [(1, 1, 0, "a tower"), (1, 1, 0, "a tower"), (1, 1, 1, "tower")], lexicon)
    both = [(1, 1, 0, "a tower", "Place", 0, 7)] * 4 + [(1, 1, 0, "tower", "Place", 2, 7)] * 4  # each text read at the places found in both
    assert twice == [*both, (1, 1, 1, "tower", "Place", 0, 5)]
    assert tagged(spark, [(1, 1, 0, "tower")], []) == []


def test_slices_of_texts_and_of_words_met_change_nothing(spark, monkeypatch):
    lexicon = [("tall tower", "Place"), ("tower", "Place")]
    lowered = [f"w{i} tall tower. w{i % 7}" for i in range(500)]
    held = grams.sieve(spark.createDataFrame(lexicon, "norm string, label string"))
    words, met = grams.Words(), []
    for lo in range(0, 500, 90):
        for doc, s, e, norms, _ in grams._found(lowered[lo : lo + 90], lowered[lo : lo + 90], words, held, [1, 2, 3]):
            met += [(lo + d, a, b, n) for d, a, b, n in zip(doc.tolist(), s.tolist(), e.tolist(), norms, strict=True) if n in ("tall tower", "tower")]
    want = [(i, a.start(), a.end(), a.group()) for i, t in enumerate(lowered) for p in ("tall tower", "tower") for a in re.finditer(p, t)]
    assert sorted(met) == sorted(want)


def test_running_starts_takes_lengths_once(spark):
    df = spark.createDataFrame([(["a"] * 1000,), ([],), (None,)], "w array<string>")
    got = df.select(running_starts(F.transform("w", lambda w: F.length(w) + 1)).alias("s"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("length(") == 1  # before, again for every run of 64
    assert [r.s for r in got.collect()] == [list(range(0, 2000, 2)), [], None]
