"""Approximate nearest neighbours over learned partitions.

On a bounded sample a graph of nearest neighbours is built and cut into partitions of equal size with few edges between
them; a small classifier then learns, for each vector, the partitions of its neighbours. Every row is filed under its most
probable partition; a query visits its several most probable ones, and what it meets there is ranked by the exact cosine.
How many are visited is measured on the sample, for a given recall.

Partitions are worked through in blocks of bounded size, so a partition may hold any share of the rows. Of rows with one and
the same vector only those with the smallest ids can be among the k nearest of anything, so the others are not visited.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fencegraph.functions.lineage import cut
from fencegraph.functions.ranking import top_rows

SAMPLE, PARTITIONS, LEAST_PER_PARTITION = 8192, 32, 64
NEIGHBOURS, SLACK = 10, 1.05
RECALL = 0.96  # on the sample; unclustered vectors then visit many partitions, clustered ones few
ROWS, QUERIES = 8192, 4096  # of a block


@dataclass(frozen=True)
class Router:
    hidden: tuple[np.ndarray, np.ndarray]
    output: tuple[np.ndarray, np.ndarray]
    visits: int

    def probabilities(self, unit: np.ndarray) -> np.ndarray:
        h = np.maximum(unit @ self.hidden[0] + self.hidden[1], 0)
        logits = h @ self.output[0] + self.output[1]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def ranked(self, unit: np.ndarray) -> np.ndarray:
        """Partitions of each row, most probable first."""
        return np.argsort(-self.probabilities(unit), axis=1, kind="stable")


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """(n, k) nearest others of each row."""
    out = np.empty((len(unit), k), np.int64)
    for lo in range(0, len(unit), 1024):
        near = unit[lo : lo + 1024] @ unit.T
        near[np.arange(len(near)), lo + np.arange(len(near))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(unit: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Partition of each vertex, none above ``SLACK`` times its share, with few edges cut.

    It starts from halves along the direction of most spread, halved again; then vertices move to the partition of most of
    their neighbours, those that gain most first, as long as there is room.
    """
    n = len(unit)
    home = np.zeros(n, np.int64)
    pieces = [np.arange(n)]
    while len(pieces) < parts:
        pieces.sort(key=len)
        big = pieces.pop()
        x = unit[big] - unit[big].mean(axis=0)
        along = x @ np.linalg.svd(x.T @ x)[0][:, 0]
        order = big[np.argsort(along, kind="stable")]
        pieces += [order[: len(order) // 2], order[len(order) // 2 :]]
    for i, p in enumerate(pieces):
        home[p] = i
    room = int(np.ceil(SLACK * n / parts))
    back: list[list[int]] = [[] for _ in range(n)]
    for u in range(n):
        for v in graph[u].tolist():
            back[v].append(u)
    links = [np.concatenate([graph[u], np.array(back[u], np.int64)]) for u in range(n)]
    held = np.bincount(home, minlength=parts)
    for _ in range(rounds):
        counts = np.zeros((n, parts), np.int32)
        for u in range(n):
            counts[u] = np.bincount(home[links[u]], minlength=parts)
        gain = counts.max(axis=1) - counts[np.arange(n), home]
        moved = 0
        for u in np.argsort(-gain, kind="stable").tolist():
            if gain[u] <= 0:
                break
            now = np.bincount(home[links[u]], minlength=parts)
            for to in np.argsort(-now, kind="stable")[:3].tolist():
                if now[to] > now[home[u]] and held[to] < room:
                    held[home[u]] -= 1
                    held[to] += 1
                    home[u] = to
                    moved += 1
                    break
        if moved < n // 200:
            break
    return home


def train_router(unit: np.ndarray, target: np.ndarray, hidden: int = 64, epochs: int = 40, seed: int = 2) -> Router:
    """Cross entropy to ``target`` (n, parts) by Adam."""
    rng = np.random.default_rng(seed)
    d, k = unit.shape[1], target.shape[1]
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)) * np.sqrt(d) ** 0.5, np.zeros(hidden), rng.normal(0, np.sqrt(2 / hidden), (hidden, k)), np.zeros(k)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(len(unit)), max(1, len(unit) // 128)):
            x, y = unit[rows], target[rows]
            a = x @ p[0] + p[1]
            h = np.maximum(a, 0)
            logits = h @ p[2] + p[3]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            d_out = (e / e.sum(axis=1, keepdims=True) - y) / len(rows)
            d_hid = (d_out @ p[2].T) * (a > 0)
            t += 1
            for i, g in enumerate((x.T @ d_hid, d_hid.sum(axis=0), h.T @ d_out, d_out.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router((p[0], p[1]), (p[2], p[3]), k)


def fit(unit: np.ndarray, partitions: int = PARTITIONS, recall: float = RECALL) -> Router:
    """From the unit vectors of the sample. Too few vectors for two partitions give one, which all visit."""
    parts = max(1, min(partitions, len(unit) // LEAST_PER_PARTITION))
    if parts == 1:
        d = unit.shape[1] if unit.size else 1
        return Router((np.zeros((d, 1)), np.zeros(1)), (np.zeros((1, 1)), np.zeros(1)), 1)
    graph = neighbour_graph(unit, NEIGHBOURS)
    home = balanced_partition(unit, graph, parts)
    target = np.zeros((len(unit), parts))
    np.add.at(target, (np.arange(len(unit)), home), 1)
    np.add.at(target, (np.repeat(np.arange(len(unit)), NEIGHBOURS), home[graph].ravel()), 1)
    learnt = train_router(unit, target / target.sum(axis=1, keepdims=True))
    ranked = learnt.ranked(unit)
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.arange(parts)[None, :].repeat(len(unit), 0), axis=1)
    needed = np.sort(place[np.repeat(np.arange(len(unit)), NEIGHBOURS), ranked[graph, 0].ravel()])
    visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return Router(learnt.hidden, learnt.output, visits)


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.array(vectors, np.float64)
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(table: DataFrame, vec_id: str, vector: str, is_query: Column, *, k: int = 5, sample: int = SAMPLE, partitions: int = PARTITIONS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest others found for each row where ``is_query`` (of ``vec_id``) holds,
    by largest cosine of the original vectors in double precision, ties to the smaller id.

    Rows with a null id or an unusable vector take no part, nor do vectors of another length than the commonest. Rows that
    repeat id and vector count once; other rows of a query's own id are not its neighbours.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension = sizes["d"] if sizes else 1
    rows = rows.where(F.size("v") == dimension)
    taken = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    router = fit(np.unique(_unit(taken), axis=0) if taken else np.zeros((0, 1)), partitions, recall)
    sent = table.sparkSession.sparkContext.broadcast(router)  # a few thousand weights

    @pandas_udf("array<int>")
    def ranked(v: pd.Series) -> pd.Series:
        return pd.Series(list(sent.value.ranked(_unit(v.tolist())).astype(np.int32)[:, : sent.value.visits])) if len(v) else pd.Series([], dtype=object)

    routed = cut(rows.withColumn("parts", ranked("v")), "routed")
    index = top_rows(routed.select("vec_id", "v", F.get("parts", 0).alias("part")).distinct(), ["v"], [F.col("vec_id")], k + 1, "copy").drop("copy")
    index = cut(index, "index")
    queries = routed.where(is_query).select("vec_id", "v", "parts").distinct().select("vec_id", "v", F.explode("parts").alias("part"))
    row_count = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # a row per partition
    query_count = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}

    def blocks(counts: dict[int, int], size: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for p in range(partitions) for x in (p, -(-counts.get(p, 0) // size) or 1)]), F.col("part"))

    def spread(df: DataFrame, own: Column, others: Column, own_name: str, other_name: str) -> DataFrame:
        return df.withColumn(own_name, F.pmod(F.xxhash64("vec_id"), own).cast("int")).withColumn(other_name, F.explode(F.sequence(F.lit(0), others - 1)))

    rb, qb = blocks(row_count, ROWS), blocks(query_count, QUERIES)
    left, right = spread(queries, qb, rb, "qb", "rb"), spread(index, rb, qb, "rb", "qb")
    keys = ["part", "rb", "qb"]

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return _nearest(q, r, k)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = top_rows(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest(q: pd.DataFrame, r: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of each query of a block among the rows of a block, exactly."""
    none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(q) or not len(r):
        return none
    order = r["vec_id"].to_numpy().argsort(kind="stable")
    ids = r["vec_id"].to_numpy()[order]
    original = np.array(r["v"].tolist(), np.float64)[order]
    unit = _unit(original)
    asked, mine = q["vec_id"].to_numpy(), np.array(q["v"].tolist(), np.float64)
    out = []
    for lo in range(0, len(q), 256):
        a = mine[lo : lo + 256]
        near = _unit(a) @ unit.T
        near[asked[lo : lo + 256][:, None] == ids[None, :]] = -np.inf
        few = min(k, near.shape[1])
        floor = -np.partition(-near, few - 1, axis=1)[:, few - 1] - 1e-9
        for i in range(len(a)):
            spots = np.flatnonzero((near[i] >= floor[i]) & (near[i] > -2))
            score = exact_cosine(a[i], original[spots])
            top = np.lexsort((ids[spots], -score))[:k]
            out.append(pd.DataFrame({"query_id": asked[lo + i], "vec_id": ids[spots][top], "score": score[top]}))
    return pd.concat(out) if out else none


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of one vector with each row, in double precision; scaled first, so no square overflows or vanishes."""
    a = a / np.abs(a).max()
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return (b * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))
