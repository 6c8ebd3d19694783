import itertools
import random

import pytest
import xxhash

from fencegraph.llm import components, simhash


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def closure(values, near):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if near(a, b):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {v: root(v) for v in values}


def near(a, b):
    return bin(a ^ b).count("1") <= 2


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_reach_every_pair_of_two_bits(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(5)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):  # chains of flips, in all parts of the fingerprint
        v = rng.getrandbits(64)
        for _ in range(25):
            values.add(v)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                v ^= 1 << b
    expected = closure(sorted(values), near)
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, "fp").collect()]
    assert all(near(a, b) and a != b for a, b in links)
    joined = {frozenset(p) for p in links}
    assert closure(sorted(values), lambda a, b: frozenset((a, b)) in joined) == expected


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Épée", "zeta"]
    texts = [None, "", " \t\n", "One", "one", "two  words", "two words"]
    base = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(6)]
    texts += base + [b.upper() for b in base] + [b + " end" for b in base] + [b.replace("alpha", "beta", 1) for b in base]
    rows = list(enumerate(texts, 10)) + [(10, None), (None, base[0])]
    prints = {i: slow_fingerprint(t) for i, t in rows if i is not None}
    root = closure(sorted(set(prints.values())), near)
    smallest = {}
    for i, f in sorted(prints.items()):
        smallest.setdefault(root[f], i)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.groups(df, "doc_id", "text").collect()]
    want = [(i, slow_fingerprint(t), smallest[root[slow_fingerprint(t)]]) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(df, "doc_id", "text").collect() == []


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (None, 3), (5000, 5001), (5001, 5000)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(200)} | {5000: 5000, 5001: 5000}
    assert got == want
