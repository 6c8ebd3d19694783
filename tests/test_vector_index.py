"""The stored vector index: recall, changes, and what a query reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fencegraph.operators import search
from fencegraph.sources.store import GraphStore
from fencegraph.sources.vector_index import RECALL, SAMPLE, VectorIndex, train, unit, visits_for

SHAPE = "work_id long, chunk_id long, chapter_ordinal int, char_start int, char_end int, text string, embedding array<double>"


def clustered(n, groups=30, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(0, groups, n)] + 0.2 * rng.normal(size=(n, dim))


def chunks(spark, x):
    rows = [(i % 2 + 1, i, i % 9 + 1, 0, 0, "t", v.tolist()) for i, v in enumerate(x)] + [(1, 90_000, 1, 0, 0, "none", None), (2, 90_001, 1, 0, 0, "zero", [0.0] * x.shape[1])]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture
def index(spark, tmp_path):
    made = VectorIndex(GraphStore(spark, str(tmp_path / "store"), 4))
    made.build(chunks(spark, clustered(1200)))
    return made


def asked(df):
    return df.filter("embedding IS NOT NULL AND chunk_id % 10 = 0").select(F.col("chunk_id").alias("q_id"), "work_id", F.col("chapter_ordinal").alias("n"), "embedding")


def test_recall_and_share_read(spark, index):
    df = chunks(spark, clustered(1200))
    centroids, visits = index.centroids()
    assert len(centroids) == round(1202**0.5 / 2) and visits <= len(centroids) / 3  # clustered vectors need few cells
    want = {(r.q_id, r.chunk_id) for r in search.top_k(asked(df), df.filter("embedding IS NOT NULL"), 5).collect()}
    rows = index.top_k(asked(df), 5).collect()
    got = {(r.q_id, r.chunk_id) for r in rows}
    assert len(want & got) >= 0.9 * len(want)
    chapter = {r.chunk_id: r.chapter_ordinal for r in df.collect()}
    assert all(chapter[r.chunk_id] <= chapter[r.q_id] for r in rows)
    every = {(r.q_id, r.chunk_id, r.score, r.rank) for r in index.top_k(asked(df), 5, visits=len(centroids)).collect()}
    assert every == {(r.q_id, r.chunk_id, r.score, r.rank) for r in search.top_k(asked(df), df.filter("embedding IS NOT NULL"), 5).collect()}


def test_a_query_reads_the_folders_of_its_cells(spark, index):
    one = asked(chunks(spark, clustered(1200))).filter("q_id = 100")
    probed, vectors = index.probed(one, visits=2)
    cells = {r.cell for r in probed.collect()}
    files = vectors.inputFiles()
    assert len(cells) == 2
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell") or "cell#" in plan.split("PartitionFilters:")[1].split("]")[0]
    read = {f.split("cell=")[1].split("/")[0] for f in vectors.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert read == {str(c) for c in cells} and files


def test_a_query_travels_with_its_cells_and_not_once_for_each(spark, index, monkeypatch):
    df = chunks(spark, clustered(1200))
    twice = asked(df).unionByName(asked(df).filter("q_id < 50"))
    monkeypatch.setattr(search, "BLOCK_ROWS", 64)  # several blocks of a work, and of a group
    for visits in (1, 3, 17):
        probed, vectors = index.probed(twice, visits)
        flat = search.best_in_blocks(probed, vectors.filter("embedding IS NOT NULL"), 5, ["work_id", "cell"])
        want = search.top_rows(flat, ["q_id", "work_id"], [F.desc("score"), F.col("chunk_id")], 5)
        found = index.top_k(twice, 5, visits)
        assert "explode(cells" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
        row = lambda r: (r.q_id, r.work_id, r.rank, r.chunk_id, r.score)
        assert sorted(map(row, found.collect())) == sorted(map(row, want.collect()))


def test_changes_reach_the_vectors(spark, index):
    df = chunks(spark, clustered(1200))
    first = df.filter("chunk_id = 100")
    index.upsert(first.withColumn("embedding", F.transform("embedding", lambda c: -c)))
    near = lambda: {r.chunk_id for r in index.top_k(asked(df).filter("q_id = 100"), 50).collect()}
    assert index.counts().agg(F.sum("n")).first()[0] == 1202 and 100 not in near()
    index.upsert(first)
    assert 100 in near()
    index.store.delete_chapters(spark.createDataFrame([(1, 2)], "work_id long, ordinal int"))
    assert index.store.rows("vectors").filter("work_id = 1 AND chapter_ordinal = 2").isEmpty()
    index.replace_works(df.filter("work_id = 2 AND chunk_id < 11"), spark.createDataFrame([(2,)], "work_id long"))
    assert {r.work_id: r.n for r in index.counts().collect()}[2] == 5
    index.store.delete_works(spark.createDataFrame([(1,)], "work_id long"))
    assert {r.work_id: r.n for r in index.counts().collect()} == {2: 5}
    assert index.store.compact("vectors", 3) and {r.work_id: r.n for r in index.counts().collect()} == {2: 5}


def test_empty_and_tiny_indexes(spark, tmp_path):
    index = VectorIndex(GraphStore(spark, str(tmp_path / "store"), 4))
    index.build(spark.createDataFrame([], SHAPE))
    q = spark.createDataFrame([(1, 1, 9, [1.0])], "q_id long, work_id long, n int, embedding array<double>")
    assert index.top_k(q, 5).collect() == []
    index.build(spark.createDataFrame([(1, 7, 1, 0, 0, "t", [2.0])], SHAPE))
    assert [(r.chunk_id, r.score) for r in index.top_k(q, 5).collect()] == [(7, 1.0)]


def test_visits_are_measured():
    x = unit(clustered(900, seed=3))
    c = train(x, 20)
    assert np.allclose(np.linalg.norm(c, axis=1), 1) and visits_for(x, c, 0.5) <= visits_for(x, c, 0.99) <= 20


def test_driver_holds_no_matrix_of_all_queries_and_the_sample():
    """Cells and visits are measured some rows at a time; whole products took 200 MB of the driver."""
    import tracemalloc

    x = unit(np.random.default_rng(3).normal(size=(SAMPLE, 16)))
    tracemalloc.start()
    centroids = train(x, 64, rounds=1)
    visits = visits_for(x, centroids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    near = x[:1024] @ x.T
    near[np.arange(1024), np.arange(1024)] = -2
    home, order = (x @ centroids.T).argmax(axis=1), np.argsort(-(x[:1024] @ centroids.T), axis=1, kind="stable").argsort(axis=1)
    needed = np.sort(np.take_along_axis(order, home[np.argsort(-near, axis=1)[:, :5]], 1).ravel())
    assert visits == needed[int(np.ceil(RECALL * len(needed)))] + 1
