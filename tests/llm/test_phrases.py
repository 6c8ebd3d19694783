import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fencegraph.llm import phrases

SHAPE = "doc_id long, text string, lang string, phrase string, n long, shard int, size string"


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)) if w]


def brute_counts(rows, longest=3):
    f = defaultdict(Counter)
    for text, lang in rows:
        for w in words_of(text):
            for n in range(1, longest + 1):
                f[lang or "und"].update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    return f


def brute(rows, longest=3, least=10, percent=50, top=2000):
    out = []
    for lang, f in brute_counts(rows, longest).items():
        n = sum(c for p, c in f.items() if " " not in p)
        cand = {p: a for p, a in f.items() if " " in p and a >= least}
        gone = set()
        for p, b in cand.items():
            w = p.split(" ")
            gone |= {q for i in range(len(w)) for j in range(i + 2, len(w) + 1) if (q := " ".join(w[i:j])) != p and q in cand and 100 * b >= percent * cand[q]}
        found = []
        for p, a in cand.items():
            w = p.split(" ")
            cuts = [(1000000 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if p not in gone:
                found.append((-score, -a, p.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1, 2, "y") for i, (t, g) in enumerate(rows)], SHAPE)


def made(seed, docs=400):
    rng = random.Random(seed)
    vocabulary = ["Of", "the", "new", "york", "city", "É", "straße", "中文", "a" * 9, "b" * 30, "x y", "~"] + [f"w{i}" for i in range(60)]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " \r\n ", "\x0b", ":", "!?"]
    rows = []
    for i in range(docs):
        n = rng.randint(0, 60)
        text = "".join(vocabulary[min(int(rng.expovariate(0.12)), len(vocabulary) - 1)] + rng.choice(ends) for _ in range(n))
        rows.append((text if i % 7 else text + "New York City the new york", rng.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "en"), (" .\n", None), ("z" * 5000 + " " + "z" * 5000 + " end", "de")] * 12 + [rows[3]] * 40


@pytest.mark.parametrize("how", [{}, {"longest": 4, "least": 4, "percent": 30, "top": 7}, {"shards": 1}])
def test_equal_to_brute_force(spark, how):
    rows = made(1)
    limits = {k: v for k, v in how.items() if k != "shards"}
    got = sorted(tuple(r) for r in phrases.collocations(table(spark, rows), "text", "lang", **how).collect())
    assert got == brute(rows, **limits) and got


def test_a_full_bitmap_changes_nothing(spark):
    rows = made(2, 300)
    f = brute_counts(rows)
    want = sorted((g, p.count(" ") + 1, p, n) for g in f for p, n in f[g].items() if n >= 3)
    got = sorted(tuple(r) for r in phrases.counts(table(spark, rows), "text", "lang", least=3, most_bits=15).where("size > 0").collect())
    assert got == want


def test_long_texts_are_cut_where_a_piece_ends(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 50)
    text = "one two, three. four five six seven! " * 9 + "eight " * 40
    batch = phrases.pa.RecordBatch.from_pydict({"text": [text.encode(), b"", b"one two"], "lang": ["en", "en", "de"]})
    got, pieces = Counter(), 0
    for group, w in phrases._chunks([batch]):
        assert group in (("en",), ("de",))
        for size, first, keys in phrases._keyed(w, "", 0, 2, [phrases.Sieve(15, b"\xff" * 4096)]):
            found, n, _ = w.counted(first, size, keys)
            got.update({(group[0], p.decode()): int(c) for p, c in zip(found, n, strict=True)})
        pieces += 1
    f = brute_counts([(text, "en"), ("one two", "de")], 2)
    assert got == {(g, p): n for g in f for p, n in f[g].items()} and pieces > 5


def test_empty_tables(spark):
    assert phrases.collocations(table(spark, []), "text", "lang").collect() == []
    assert phrases.collocations(table(spark, [(None, None), ("one two", "en")]), "text", "lang").collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB \t.\n\x0béİz", max_size=40), max_size=5))
def test_words_and_phrases_of_bytes(texts):
    w = phrases.Words([t.encode() for t in texts])
    for size, first, keys in phrases._keyed(w, "en", 0, 2, [phrases.Sieve(15, b"\xff" * 4096)]):
        found, n, odd = w.counted(first, size, keys)
        want = Counter(" ".join(p[i : i + size]) for t in texts for p in words_of(t) for i in range(len(p) - size + 1))
        assert dict(zip([p.decode() for p in found], n.tolist(), strict=True)) == want and not odd


def test_phrases_of_one_key_are_told_apart():
    w = phrases.Words([b"aa bb aa cccccccccc cccccccccd aa"])
    same = phrases.np.zeros(6, phrases.np.uint64)
    found, n, odd = w.counted(phrases.np.arange(6), 1, same)
    assert found == [b"aa"] and n.tolist() == [3] and odd == {b"bb": 1, b"cccccccccc": 1, b"cccccccccd": 1}
