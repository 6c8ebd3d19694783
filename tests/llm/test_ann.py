import numpy as np
from pyspark.sql import functions as F

from fencegraph.llm import ann


def brute(rows, asked, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if asked(i):
            others = sorted((-float(ann.exact_cosine(np.array(v, float), np.array([w], float))[0]), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = [(j, round(-s, 12)) for s, j in others[:k]]
    return out


def answers(df, k=5, **how):
    got = {}
    for r in ann.search(df, "vec_id", "embedding", F.col("vec_id") % 5 == 0, k=k, **how).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, round(r.score, 12)))
    return got


def test_few_vectors_are_answered_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(40)]
    rows += [(40, None), (45, [1.0, float("nan"), 2.0]), (50, [float("inf"), 1.0, 1.0]), (55, [0.0, 0.0, 0.0]), (60, [1.0, None, 2.0]), (None, [1.0, 1.0, 1.0]), (65, [1.0, 2.0]), (70, [1e300, 1e300, 0.0]), (75, [1e-300, 0.0, 1e-300]), (15, rows[15][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 3], lambda i: i % 5 == 0, 5)
    assert answers(df) == want


def test_copies_of_one_vector_and_small_tables(spark):
    rows = [(i, [1.0, 1.0]) for i in range(300)] + [(1000 + i, [1.0, 1.0 + 0.01 * (i + 1)]) for i in range(10)]
    got = answers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got == brute(rows, lambda i: i % 5 == 0, 5)
    assert answers(spark.createDataFrame([(5, [1.0])], "vec_id long, embedding array<double>")) == {}
    assert answers(spark.createDataFrame([(5, [1.0]), (6, [2.0])], "vec_id long, embedding array<double>")) == {5: [(6, 1.0)]}
    assert answers(spark.createDataFrame([], "vec_id long, embedding array<double>")) == {}


def test_partitions_are_balanced_and_recall_is_kept(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(24, 16))
    x = np.concatenate([c + 0.35 * rng.normal(size=(100, 16)) for c in centres])
    unit = ann._unit(list(x))
    home = ann.balanced_partition(unit, ann.neighbour_graph(unit, 10), 16)
    assert np.bincount(home, minlength=16).max() <= np.ceil(1.05 * len(x) / 16)
    router = ann.fit(unit, 16)
    assert router.visits < 8  # clustered vectors need few partitions
    monkeypatch.setattr(ann, "ROWS", 90)
    monkeypatch.setattr(ann, "QUERIES", 20)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = answers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), partitions=16), brute(rows, lambda i: i % 5 == 0, 5)
    assert set(got) == set(want)
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 5 for i in want]) >= 0.9
