import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fencegraph.llm import decontaminate as dec


def slow_align(item, window):
    best, h = 0, {}
    for i in range(len(item) + 1):
        for j in range(len(window) + 1):
            h[i, j] = 0 if not i or not j else max(0, h[i - 1, j - 1] + (1 if item[i - 1] == window[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_equals_the_full_table():
    rng = random.Random(8)
    for _ in range(60):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        windows = np.array([[rng.randrange(-1, 4) for _ in range(20)] for _ in range(5)])
        score, first, last = dec.align(np.array(item), windows)
        for row, s, f, e in zip(windows.tolist(), score, first, last):
            assert s == slow_align(item, row)
            assert s == slow_align(item, row[f:e])  # the span alone holds the whole alignment


def find(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, leaks int")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = dec.find(d, "text", b, "item_id", "text").collect()
    assert len(rows) == len(docs)
    return {(r.doc_id, x.item_id): (x.score, x.first, x.stop) for r in rows for x in r.leaks}


def test_copies_edits_and_clean_texts(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(15, 40)))) for i in range(12)] + [(50, "Four rare words here"), (51, "two words"), (52, "..."), (53, None), (None, "nothing at all")]
    docs, want = [], set()
    for i in range(12):
        words = items[i][1].split()
        docs.append((i, " ".join(say(200) + [items[i][1].upper() + ","] + say(200)), 0))
        edited = [w if k % 6 else "changed" for k, w in enumerate(words)]
        docs.append((100 + i, " ".join(say(50) + edited + say(3000)), 0))
        inserted = [x for k, w in enumerate(words) for x in ([w, "filler"] if k % 7 == 3 else [w])]
        docs.append((200 + i, " ".join(inserted), 0))
        want |= {(i, i), (100 + i, i), (200 + i, i)}
        docs.append((300 + i, " ".join(say(300) + words[:4] + say(300)), 0))
    docs += [(900, None, 0), (901, "", 0), (902, "x four RARE words, here y", 0), (903, "four rare things here", 0), (904, "say two words now", 0), (905, "two other words", 0), (None, items[0][1], 0), (0, docs[0][1], 0)]
    want |= {(902, 50), (904, 51), (None, 0)}
    got = find(spark, docs, items)
    assert set(got) == want
    assert all(got[i, i][0] == 1.0 and got[i, i][1:] == (200, 200 + len(items[i][1].split())) for i in range(12))


def test_a_passage_in_every_document_is_still_found(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(i, f"some {i} text {passage} and more {i}", 0) for i in range(60)] + [(60, (passage + " gap ") * 300, 0)]
    assert set(find(spark, docs, [(7, passage), (8, "other words that are nowhere in any of these texts")])) == {(i, 7) for i in range(61)}


def test_many_items_and_empty_tables(spark):
    items = [(i, " ".join(f"i{i}x{k}" for k in range(12))) for i in range(9)]
    docs = [(i, "before " + items[i][1] + " after", 0) for i in range(9)]
    assert set(find(spark, docs, items)) == {(i, i) for i in range(9)}
    assert find(spark, docs, []) == {} and find(spark, [], items) == {}


def test_edited_and_half_copies_without_a_verbatim_one(spark):
    rng = random.Random(4)
    items = [(n, [f"i{n}x{k}" for k in range(n)]) for n in (20, 30, 40, 60, 100)]
    filler = lambda: [f"f{rng.randrange(500)}" for _ in range(80)]
    docs, want = [], set()
    for n, words in items:
        copies = [[w if k % every != every - 1 else "changed" for k, w in enumerate(words)] for every in (4, 5, 6)]
        if n >= 40:
            copies += [words[: n // 2], words[n // 2 :]]
        for j, copy in enumerate(copies):
            docs.append((1000 * j + n, " ".join(filler() + copy + filler()), 0))
            # every fourth word changed scores one half at its best only where the copy ends in a match
            if j or (n - n // 4) - (n // 4 - 1 if n % 4 == 0 else n // 4) >= n / 2:
                want.add((1000 * j + n, n))
        docs.append((9000 + n, " ".join(filler() + words[: n // 3] + filler()), 0))
    assert len(want) == 21
    assert set(find(spark, docs, [(n, " ".join(w)) for n, w in items])) == want


def test_what_is_dropped_before_aligning_is_below_the_bar(monkeypatch):
    rng = random.Random(5)
    items = [[b"%d" % rng.randrange(30) for _ in range(rng.randrange(3, 30))] for _ in range(20)]
    full = dec.bar_of
    for _ in range(40):
        words = [b"%d" % rng.randrange(30) for _ in range(60)]
        words[20:20] = [w for w in items[rng.randrange(20)] if rng.random() < 0.85]
        for item in items:
            spots = list(range(-2, len(words) // dec.step_of(len(item)) + 1))
            monkeypatch.setattr(dec, "bar_of", lambda n: -1)
            every = dec.leak_of(words, item, spots)
            monkeypatch.setattr(dec, "bar_of", full)
            assert dec.leak_of(words, item, spots) == (every if round(every[0] * len(item)) >= full(len(item)) else None)


def edited(words, rng, how):
    """Words changed, dropped or added, alone or after every second one."""
    if how == "every second":
        return [x for k, w in enumerate(words) for x in ([w, f"added{k}"] if k % 2 else [w])]
    out = []
    for w in words:
        x = rng.random()
        out += [w] if x > how else [f"c{rng.randrange(9)}"] if x > 0.6 * how else [] if x > 0.3 * how else [w, f"c{rng.randrange(9)}"]
    return out


def test_every_pair_that_reaches_the_bar_is_found(spark):
    rng = random.Random(12)
    common = [f"w{i}" for i in range(14)]  # so that pairs of words recur in all items and texts
    items = [[rng.choice(common) if rng.random() < 0.6 else f"i{i}x{k}" for k in range(n)] for i, n in enumerate([1, 2, 3, 5, 8, 9, 10, 11, 13, 15, 16, 20, 25, 30, 50])]
    items += [["same"] * 12, ["a", "b"] * 10]
    docs = []
    for item in items:
        for how in (0.0, 0.15, 0.25, 0.35, 0.5, "every second"):
            docs.append([rng.choice(common) for _ in range(rng.randrange(30))] + edited(item, rng, how) + [rng.choice(common) for _ in range(rng.randrange(30))])
    docs += [["same"] * 400, ["b", "a"] * 300, common * 3]
    want = {}
    for d, words in enumerate(docs):
        for i, item in enumerate(items):
            number = {w: j for j, w in enumerate(dict.fromkeys(item))}
            score = int(dec.align(np.array([number[w] for w in item]), np.array([[number.get(w, -1) for w in words]]))[0][0])
            if score >= dec.bar_of(len(item)):
                want[d, i] = score / len(item)
    got = find(spark, [(d, " ".join(w), 0) for d, w in enumerate(docs)], [(i, " ".join(w)) for i, w in enumerate(items)])
    assert {k: v[0] for k, v in got.items()} == want
    second = [6 * i + 5 for i, item in enumerate(items) if len(item) >= 16]
    assert all((d, d // 6) in got for d in second)  # a word added after every second one leaves no three in a row


def test_leaks_hold_the_seeds_that_must_meet(spark):
    rng = random.Random(3)
    for n in range(1, 70):
        row = spark.range(1).select(dec._seeds_needed(F.lit(n)).alias("needed"), dec._seeds_met(F.lit(n)).alias("met")).first() if n in (1, 2, 8, 9, 10, 11, 15, 16, 17, 40, 69) else None
        if row is None:
            continue
        bar = math.ceil(dec.bar_of(n))
        assert 1 <= row.met <= max(1, bar - 1) and row.met <= row.needed <= max(1, n - 1)
        for _ in range(20 if n > 1 else 0):
            matches = rng.randrange(bar, n + 1)
            spoiled = rng.sample(range(matches - 1), min(matches - bar, matches - 1))  # one edit in each of these gaps
            whole = matches - 1 - len(spoiled) - 0
            assert whole >= bar - 1 and whole - ((n - 1) - row.needed) >= row.met


def test_short_items_and_scripts_without_blanks(spark):
    nine = [f"n{k}" for k in range(9)]
    changed = " ".join([*nine[:4], "other", *nine[5:]])
    docs = [(1, "before it " + changed + " behind it", 0), (2, "before it " + " ".join([*nine[:3], "other", "other", *nine[5:]]), 0)]
    docs += [(3, "これは長い文の中にある東京は日本の首都である。そして続く", 0), (4, "東京は大きい", 0), (5, "คำตอบกรุงเทพเป็นเมืองหลวงของไทยครับ", 0)]
    got = find(spark, docs, [(9, " ".join(nine)), (10, "東京は日本の首都である"), (11, "กรุงเทพเป็นเมืองหลวงของไทย")])
    assert set(got) == {(1, 9), (3, 10), (5, 11)} and got[3, 10][0] == 1.0 and got[1, 9][0] == 7 / 9


def test_scan_of_a_large_batch_stays_small():
    """Word arrays of four megabytes of text at once took eighty megabytes of a worker."""
    import tracemalloc

    batch = pa.record_batch([pa.array(["some words of a text " * 500] * 400)], names=["text"])
    tracemalloc.start()
    found = sum(len(dec.grams(texts, False)[2]) for _, texts in dec._chunks(iter([batch]), "text"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 400 * (2500 - 1)
    assert peak < 48 << 20
