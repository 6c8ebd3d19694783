"""Whitening of embeddings, each distinct vector once.

Every component c becomes the whole number floor(64 c) + 1000000. Identical rows of such numbers are grouped, and their counts
(or one for each, with ``weighted=False``) are the fit weights. Sums are taken in whole numbers, the covariance is a weighted
matrix product of centred rows, each task's part of it added up by Spark; only that matrix, bounded by the square of the
dimension, goes to the driver for its eigenvectors. Each distinct vector is projected once and joined back to its rows.

Rows whose vector is null, empty, or holds null or non-finite components are left out, and so are vectors of another length
than the commonest (of equally common ones the shorter). Repeated rows and null ids are answered row by row. Components
whose eigenvalue vanishes against the largest (below ``VANISHING`` of it: constant or dependent dimensions) have no unit
variance to be scaled to and are not returned, so a table of equal vectors gives no rows, as an empty one does. A component
beyond 2^52 raises an error rather than lose digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencegraph.functions.lineage import cut

SCALE, SHIFT, VANISHING, LARGEST = 64, 1_000_000, 1e-12, 1 << 52


@dataclass(frozen=True)
class Fit:
    """Mean (as sum and count) and the unit eigenvectors, as rows, by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, subtracted in whole numbers."""
        return (_numerators(x, self.n, self.sums) / self.n).astype(np.float64)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)


def _numerators(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, in 64-bit numbers where they hold it, else in numbers of any size."""
    largest = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if largest < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Sum over the dimensions of (n x - S)^2 for each row, exact at any size."""
    y = _numerators(x, n, sums)
    if y.dtype == np.int64 and y.size and int(np.abs(y).max()) ** 2 * y.shape[1] < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    return [sum(int(v) * int(v) for v in row) for row in y]


def finite(vector: Column) -> Column:
    """Neither null nor empty, without null or non-finite components."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def whole(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each component."""
    scaled = F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c))
    return F.transform(scaled, lambda c: F.when(F.abs(c) < LARGEST, c + F.lit(SHIFT)).otherwise(F.raise_error(F.lit("a component is too large to be counted exactly")).cast("long")))


def _matrix(batch: pa.RecordBatch, name: str, kind: type, d: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, d)


def covariance(df: DataFrame, column: str, weight: str, d: int, centre) -> np.ndarray:
    """Weighted covariance of the arrays in ``column``; ``centre`` turns a matrix of them into centred doubles.

    Every task adds up its own rows and emits one upper triangle, whose cells Spark sums over the tasks.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((d, d)), 0
        for batch in batches:
            if batch.num_rows:
                y = centre(batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                w = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
                total += y.T @ (y * w[:, None])
                n += int(w.sum())
        if n:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j]), pa.array(np.full(len(i), n))], names=["i", "j", "s", "n"])

    cells = df.select(column, weight).mapInArrow(part, "i long, j long, s double, n long").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    out = np.zeros((d, d))
    for c in cells:  # half the square of the dimension
        out[c.i, c.j] = out[c.j, c.i] = c.s / c.n
    return out


def _by_dimension(df: DataFrame, column: str, term: Column) -> list:
    """Sum of ``term`` (of c, a component, and w, the row's weight) for each place of the arrays in ``column``."""
    cells = df.select("w", F.posexplode(column).alias("at", "c")).groupBy("at").agg(F.sum(term).alias("s")).collect()
    return [r.s for r in sorted(cells, key=lambda r: r["at"])]


def whiten(table: DataFrame, vec_id: str, vector: str, *, components: int = 32, weighted: bool = True) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable row of ``table`` and
    component, numbered from 1 by falling eigenvalue. ``deviation`` is an exact decimal; ``identity_error`` is measured on the
    whitened vectors. With ``weighted=False`` each distinct vector counts once in the fit.
    """
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(finite(F.col("v")))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = common["d"] if common else 1
    rows = rows.where(F.size("v") == d).select("vec_id", whole(F.col("v")).alias("x"))
    weight = F.count(F.lit(1)) if weighted else F.lit(1).cast("long")
    distinct = cut(rows.groupBy("x").agg(weight.alias("w")), "distinct")
    n = distinct.agg(F.sum("w").alias("n")).first()["n"] or 0
    term = F.col("c").cast("decimal(19,0)") * F.col("w").cast("decimal(18,0)")
    sums = tuple(int(s) for s in _by_dimension(distinct, "x", term))
    shape = "vec_id {}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double".format(rows.schema["vec_id"].dataType.simpleString())
    nothing = table.sparkSession.createDataFrame([], shape)
    if n == 0:
        return nothing
    raw = Fit(n, sums, np.zeros((0, d)), np.zeros(0), np.zeros(0))
    matrix = covariance(distinct, "x", "w", d, raw.centred)
    values, vectors = np.linalg.eigh(matrix)
    keep = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > max(values.max(), 0) * VANISHING]
    if not keep:
        return nothing
    fit = Fit(n, sums, np.ascontiguousarray(vectors.T[keep]), values[keep], values[keep] / np.trace(matrix))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "x", np.int64, d)
            for lo in range(0, len(x), 4096):
                part = x[lo : lo + 4096]
                exact = pa.array([str(v) for v in deviations(part, n, sums)], pa.string())
                white = pa.FixedSizeListArray.from_arrays(pa.array(fit.project(part).ravel()), len(keep)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("x").slice(lo, 4096), batch.column("w").slice(lo, 4096), exact, white], names=["x", "w", "deviation", "white"])

    white = cut(distinct.mapInArrow(project, "x array<bigint>, w bigint, deviation string, white array<double>"), "white")
    k = len(keep)
    means = np.array(_by_dimension(white, "white", F.col("c") * F.col("w") / n))
    again = covariance(white, "white", "w", k, lambda y: y.astype(np.float64) - means)
    error = float(np.abs(again - np.eye(k)).max())
    share = F.array(*[F.lit(float(e)) for e in fit.explained])
    joined = rows.join(white.select("x", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "white"), "x")
    return joined.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
