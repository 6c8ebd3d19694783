import numpy as np
import pytest

from fencegraph.llm import whitening


def brute(vectors, components=32):
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = (x * n - s) / n
    cov = y.T @ y / n
    values, vecs = np.linalg.eigh(cov)
    keep = [i for i in np.argsort(-values)[:components] if values[i] > values.max() * 1e-12]
    return n, [sum(int(v) ** 2 for v in row) for row in (x * n - s)], y @ vecs[:, keep] / np.sqrt(values[keep]), values[keep] / np.trace(cov)


def answer(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], "vec_id long, embedding array<double>, n int, x string, component string")
    return sorted((r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in whitening.whiten(df, "vec_id", "embedding", **how).collect())


def test_equal_to_numpy_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 5)) @ rng.normal(size=(5, 5))
    x = np.vstack([x, np.repeat(x[:1], 90, axis=0), x[3:5] + 1e-9])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(500, None), (501, []), (502, [1.0, None, 1.0, 1.0, 1.0]), (503, [float("nan")] * 5), (504, [float("inf")] * 5), (505, [1.0, 2.0])]
    got = answer(spark, rows + odd, components=3)
    n, dev, white, explained = brute(x, 3)
    assert len(got) == 3 * len(x) and {g[2] for g in got} == {n}
    for k in range(3):
        mine = np.array([g[4] for g in got if g[1] == k + 1])
        assert np.allclose(mine, white[:, k], atol=1e-8) or np.allclose(mine, -white[:, k], atol=1e-8)
        assert np.isclose([g[5] for g in got if g[1] == k + 1][0], explained[k])
    assert [g[3] for g in got if g[1] == 1] == dev
    assert max(g[6] for g in got) < 1e-8


def test_distinct_vectors_may_count_once(spark):
    rows = [(i, [float(i % 4), float(i % 2)]) for i in range(12)] + [(100 + i, [3.0, 1.0]) for i in range(50)]
    once, weighted = answer(spark, rows, weighted=False), answer(spark, rows)
    assert once[0][2] == 4 and weighted[0][2] == 62 and len(once) == len(weighted) == 2 * 62
    assert once[0][6] < 1e-9 and weighted[0][6] < 1e-9


def test_null_and_repeated_ids_constant_dimensions_and_empty_tables(spark):
    assert answer(spark, []) == []
    assert answer(spark, [(1, [2.0, 3.0])]) == [] and answer(spark, [(1, [2.0]), (2, [2.0])]) == []
    df = spark.createDataFrame([(None, [1.0, 5.0]), (None, [2.0, 5.0]), (7, [1.0, 5.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(df, "vec_id", "embedding").collect()
    assert len(got) == 3 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12


def test_large_components_and_counts_are_exact(spark):
    rows = [(1, [1e12, 0.5]), (2, [-1e12, 0.25]), (3, [3.0, 4.0])]
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(r[j] for r in x) for j in range(2)]
    want = [sum((3 * r[j] - s[j]) ** 2 for j in range(2)) for r in x]
    assert [g[3] for g in answer(spark, rows) if g[1] == 1] == want
    assert whitening.deviations(np.array([[1 << 50]]), 1 << 40, (3,)) == [((1 << 90) - 3) ** 2]
    with pytest.raises(Exception, match="too large"):
        answer(spark, [(1, [1e200]), (2, [1.0])])
