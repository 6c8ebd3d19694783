import numpy as np
import pytest

from fencegraph.llm import pivots

SHAPE = "vec_id long, embedding array<double>, label int, n_links string, node int, v string"


def brute(rows, least=0.98):
    """n_links, component and kept of each row, in order."""
    ok = [i for i, (d, v, lab) in enumerate(rows) if d is not None and lab is not None and v is not None and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = [[d, 0, d, True] for d, _, _ in rows]
    x = pivots.unit(np.array([rows[i][1] for i in ok], float)) if ok else np.zeros((0, 16))
    near = (x @ x.T >= least) & np.equal.outer([rows[i][2] for i in ok], [rows[i][2] for i in ok])
    np.fill_diagonal(near, False)
    root = np.array([rows[i][0] for i in ok])
    while True:
        low = np.where(near, root[None, :], root[:, None]).min(axis=1, initial=1 << 60) if len(ok) else root
        low = np.minimum(low, root)
        if (low == root).all():
            break
        root = low
    for a, i in enumerate(ok):
        out[i] = [rows[i][0], int(near[a].sum()), int(root[a]), rows[i][0] == int(root[a])]
    return out


def answer(spark, rows, **how):
    df = spark.createDataFrame([(d, v, lab, "x", 1, "y") for d, v, lab in rows], SHAPE)
    return [list(r) for r in pivots.groups(df, "vec_id", "embedding", "label", **how).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def table(seed=0):
    """Loose vectors, small groups of near copies, a large one, exact copies, and rows that link with nothing."""
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=16) for _ in range(200)]
    for size in (2, 3, 5, 120):
        c = rng.normal(size=16)
        x += [c + rng.normal(size=16) * 0.14 * np.linalg.norm(c) / 4 * rng.random() for _ in range(size)]
    x += [x[0]] * 4 + [x[201] * 3]
    rows = [(i, [float(c) for c in v], int(i % 13 == 0)) for i, v in enumerate(x)]
    odd = [[1.0, float("nan")] * 8, [float("inf")] * 16, [0.0] * 16, [1.0, None] * 8, [1.0, 2.0], [], None]
    rows += [(900 + i, v, 0) for i, v in enumerate(odd)] + [(None, rows[0][1], 0), (950, rows[0][1], None), rows[1], rows[1]]
    return rows + [(960, [c * 1e300 for c in rows[0][1]], 0), (961, [c * 1e-300 for c in rows[0][1]], 0)]


@pytest.mark.parametrize("how", [{"lists": 1, "block": 17}, {"lists": 2, "block": 30, "pivots": 20}, {"lists": 3, "pivots": 14}, {"pivots": 5}])
def test_links_and_components_equal_brute_force(spark, how):
    rows = table()
    assert ordered(answer(spark, rows, **how)) == ordered(brute(rows))


def test_small_tables(spark):
    assert answer(spark, []) == []
    one = [(4, [1.0] * 16, 1)]
    assert answer(spark, one) == [[4, 0, 4, True]]
    assert ordered(answer(spark, [*one, (2, [2.0] * 16, 1), (3, [1.0] * 16, 2), (1, None, 1)])) == [[1, 0, 1, True], [2, 1, 2, True], [3, 0, 3, True], [4, 1, 2, False]]


def test_recall_of_pairs_at_the_bar():
    rng = np.random.default_rng(3)
    x = pivots.unit(rng.normal(size=(6000, 64)))
    aside = rng.normal(size=(2000, 64))
    aside = pivots.unit(aside - (aside * x[:2000]).sum(axis=1, keepdims=True) * x[:2000])
    y = 0.98 * x[:2000] + np.sqrt(1 - 0.98**2) * aside
    points = pivots.choose_pivots(x)
    a, b = (pivots.nearest_pivots(v, points, pivots.NEAREST) for v in (x[:2000], y))
    assert np.mean([len({*u} & {*v}) >= pivots.SHARED for u, v in zip(a, b, strict=True)]) > 0.98


def test_pivots_are_no_copies_of_each_other():
    x = pivots.unit(np.random.default_rng(5).normal(size=(50, 8)))
    p = pivots.choose_pivots(np.vstack([x, x]), 200)
    assert len(p) <= 50 and (np.triu(p @ p.T, 1) < pivots.APART).all()
    assert pivots.list_length(10_000, 4096, 512, 12, 7) == 1 and pivots.list_length(10**7, 4096, 512, 12, 7) > 1
