"""A stored vector index: an inverted file of cells around trained centroids, in the snapshots of a ``GraphStore``.

Vectors lie in a folder per cell, sorted by work, with the chunk they belong to. A query reads the folders of its nearest cells and
no others, and scores what the fence lets through exactly. Adding, replacing and deleting are changes of the store: rows and
keys in proportion to the change, in one step, and what deletes a work or a chapter there deletes its vectors.

Centroids come from a bounded sample (``SAMPLE`` vectors). How many cells a query visits is measured on that sample when the
index is built, for a given recall of its nearest neighbours; vectors without clusters then visit many cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fencegraph.functions.ranking import top_rows
from fencegraph.operators import search
from fencegraph.sources.store import GraphStore

SAMPLE, MOST_CELLS, RECALL, NEIGHBOURS = 8192, 1024, 0.97, 5
AT_ONCE = 128  # rows of a product of matrices that the driver holds
NOWHERE = -1  # the work id of rows that belong to no work


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def train(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids by spherical k-means; a cell that runs empty takes the vector that fits its own worst."""
    centroids = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        home, fit = nearest(x, centroids)
        for c in range(cells):
            mine = x[home == c]
            centroids[c] = mine.sum(axis=0) if len(mine) else x[fit.argmin()]
        centroids = unit(centroids)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its cosine, some rows at a time."""
    home, fit = np.empty(len(x), np.int64), np.empty(len(x))
    for lo in range(0, len(x), AT_ONCE):
        near = x[lo : lo + AT_ONCE] @ centroids.T
        home[lo : lo + AT_ONCE], fit[lo : lo + AT_ONCE] = near.argmax(axis=1), near.max(axis=1)
    return home, fit


def visits_for(x: np.ndarray, centroids: np.ndarray, recall: float = RECALL, queries: int = 1024) -> int:
    """How many nearest cells of a vector hold ``recall`` of its nearest others, on average over some of ``x``."""
    k = min(NEIGHBOURS, len(x) - 1)
    if k < 1:
        return 1
    home, _ = nearest(x, centroids)
    needed = []
    for lo in range(0, min(queries, len(x)), AT_ONCE):
        asked = x[lo : min(lo + AT_ONCE, queries)]
        near = asked @ x.T
        near[np.arange(len(asked)), lo + np.arange(len(asked))] = -2
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(asked), 0), axis=1)
        needed.append(np.take_along_axis(place, home[top], 1).ravel())
    every = np.sort(np.concatenate(needed))
    return int(every[min(len(every) - 1, int(np.ceil(recall * len(every))))]) + 1


class VectorIndex:
    """Over the tables ``vectors`` and ``centroids`` of a store."""

    def __init__(self, store: GraphStore) -> None:
        self.store = store

    def build(self, chunks: DataFrame, cells: int | None = None, recall: float = RECALL) -> None:
        """Index all ``chunks`` (see ``search.index_chunks``) in place of what was indexed."""
        n = chunks.count()
        some = chunks.filter("embedding IS NOT NULL").orderBy(F.xxhash64("work_id", "chunk_id")).limit(SAMPLE).select("embedding").collect()
        x = unit(np.array([r.embedding for r in some], float)) if some else np.zeros((0, 1))
        count = min(cells or max(1, min(MOST_CELLS, round(n**0.5 / 2))), max(1, len(x)))
        centroids = train(x, count) if len(x) else np.zeros((1, 1))
        visits = visits_for(x, centroids, recall) if len(x) else 1
        spark = self.store.spark
        with self.store.change():
            self.store.write("centroids", spark.createDataFrame([(NOWHERE, i, visits, c.tolist()) for i, c in enumerate(centroids)], "work_id long, cell int, visits int, centroid array<double>"))
            self.store.write("vectors", self.filed(chunks, centroids))

    def centroids(self) -> tuple[np.ndarray, int]:
        """(cells, dimension) and the number of cells a query visits."""
        rows = sorted(self.store.rows("centroids").collect(), key=lambda r: r.cell)  # MOST_CELLS rows at most
        return np.array([r.centroid for r in rows], float), rows[0].visits if rows else 1

    def filed(self, chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
        """Chunks with the cell of their nearest centroid; null and zero vectors in cell 0."""
        return self._nearest(chunks, centroids, 1).withColumn("cell", F.get("cells", 0)).drop("cells")

    def _nearest(self, rows: DataFrame, centroids: np.ndarray, visits: int) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(centroids)  # MOST_CELLS vectors at most

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = sent.value
            for batch in batches:
                v = [x if x is not None and len(x) == c.shape[1] else np.zeros(c.shape[1]) for x in batch.column("embedding").to_pylist()]
                near = unit(np.array(v, float).reshape(len(v), c.shape[1])) @ c.T
                cells = np.argsort(-near, axis=1, kind="stable")[:, :visits].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

        shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cells array<int>"
        return rows.mapInArrow(work, shape)

    def upsert(self, fresh: DataFrame) -> None:
        """Add chunks; the same chunk of a work is replaced."""
        self.store.replace("vectors", fresh.select("work_id", "chunk_id"), self.filed(fresh, self.centroids()[0]))

    def replace_works(self, fresh: DataFrame, works: DataFrame) -> None:
        """``fresh`` in place of all that was indexed of ``works``."""
        self.store.replace("vectors", works.select("work_id"), self.filed(fresh, self.centroids()[0]))

    def counts(self) -> DataFrame:
        return self.store.counts("vectors")

    def _visiting(self, queries: DataFrame, visits: int | None) -> tuple[DataFrame, DataFrame, int]:
        """Queries with the ``cells`` that they visit, the vectors of those cells, whose folders alone are read, and how many each visits."""
        centroids, measured = self.centroids()
        asked = self._nearest(queries.select("q_id", "work_id", "n", F.col("embedding").cast("array<double>").alias("embedding")), centroids, visits or measured)
        asked = asked.withColumn("cells", F.col("cells").cast("array<smallint>" if len(centroids) <= 1 << 15 else "array<int>"))
        wanted = [r.cell for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]  # MOST_CELLS at most
        return asked, self.store.rows("vectors").filter(F.col("cell").isin(wanted)), visits or measured

    def probed(self, queries: DataFrame, visits: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Queries, a row for each cell that they visit, and the vectors of those cells, whose folders alone are read."""
        asked, vectors, _ = self._visiting(queries, visits)
        return asked.withColumn("cell", F.explode(F.col("cells").cast("array<int>"))).drop("cells"), vectors

    def top_k(self, queries: DataFrame, k: int, visits: int | None = None) -> DataFrame:
        """Fenced top-k (q_id, work_id, chunk_id, score, rank) among the cells that each query visits, exactly scored; in the order
        of ``search.top_k``. A query travels with the list of its cells, not once for each."""
        asked, vectors, each = self._visiting(queries, visits)
        flat = search.best_in_cells(asked, vectors.filter("embedding IS NOT NULL"), k, each)
        return top_rows(flat, ["q_id", "work_id"], [F.desc("score"), F.col("chunk_id")], k)
