"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte of a text is a position. One recurrent network reads a text forwards, one backwards; a linear layer over both
states labels each position, and a document's probabilities are the mean of those of its positions. The network is trained
here in numpy by backpropagation through time. Gates and candidate are piecewise linear (hard sigmoid, hard tanh).

Long texts are read in windows of ``CORE`` positions with ``WARM`` more on either side, in which the state settles and
nothing is labelled, so every byte of every text is labelled once and a window costs the same in any text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencegraph.functions.ranking import top_rows
from fencegraph.llm.common import small_batches

UNKNOWN = "und"
CORE, WARM, LANES = 992, 16, 256
PAD = 256  # symbol beside the 256 byte values: before and after a text


@dataclass(frozen=True)
class Network:
    """Weights per direction (first axis): input tables by symbol, recurrent matrices, output layer."""

    languages: tuple[str, ...]
    inputs: tuple[np.ndarray, ...]  # three of (2, 257, hidden): update, reset, candidate
    recurrent: tuple[np.ndarray, ...]  # three of (2, hidden, hidden)
    output: np.ndarray  # (2, hidden, languages)
    bias: np.ndarray  # (languages,)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _both_ways(codes: np.ndarray) -> np.ndarray:
    """(time, lanes) symbols to (time, 2, lanes): as they stand, and reversed in time."""
    return np.stack([codes, codes[::-1]], axis=1)


def _steps(net: Network, codes: np.ndarray) -> Iterator[np.ndarray]:
    """States (2, lanes, hidden) of both directions after each of their symbols, in an array that the next step overwrites."""
    steps, lanes = codes.shape
    hidden = net.output.shape[1]
    tables = [t.reshape(-1, hidden) for t in net.inputs]
    symbols = _both_ways(codes).astype(np.int64) + np.array([0, PAD + 1])[:, None]
    h = np.zeros((2, lanes, hidden), np.float32)
    for t in range(steps):
        x = symbols[t]
        z = np.matmul(h, net.recurrent[0])
        z += np.take(tables[0], x, axis=0)
        np.clip(z, 0, 1, out=z)
        r = np.matmul(h, net.recurrent[1])
        r += np.take(tables[1], x, axis=0)
        np.clip(r, 0, 1, out=r)
        n = np.matmul(h, net.recurrent[2])
        n *= r
        n += np.take(tables[2], x, axis=0)
        np.clip(n, -1, 1, out=n)
        h -= n
        h *= z
        h += n
        yield h


def states(net: Network, codes: np.ndarray) -> np.ndarray:
    """States (2, time, lanes, hidden) after each symbol, both aligned to the position of the symbol."""
    steps, lanes = codes.shape
    out = np.empty((2, steps, lanes, net.output.shape[1]), np.float32)
    for t, h in enumerate(_steps(net, codes)):
        out[0, t], out[1, steps - 1 - t] = h
    return out


def position_probabilities(net: Network, codes: np.ndarray) -> np.ndarray:
    """(time, lanes, languages). Each state is labelled as it is met: all of them would be several times as large as their labels."""
    steps, lanes = codes.shape
    logits = np.zeros((steps, lanes, net.output.shape[2]), np.float32)
    for t, h in enumerate(_steps(net, codes)):
        ahead, back = np.matmul(h, net.output)
        logits[t] += ahead
        logits[steps - 1 - t] += back
    logits += net.bias
    np.clip(logits, -30, 30, out=logits)
    np.exp(logits, out=logits)
    logits /= logits @ np.ones((logits.shape[-1], 1), np.float32)
    return logits


def train(
    windows: list[bytes], labels: list[int], languages: tuple[str, ...], *, hidden: int = 0, span: int = 64, lanes: int = 64, steps: int = 500, rate: float = 0.02, seed: int = 7
) -> Network:
    """Adam over random windows of ``span`` bytes; the loss is the cross entropy of every position. Each step has ``lanes``
    windows, or the next multiple of the number of languages, so every step sees every language alike; without ``hidden`` the
    states are 8 wide, wider for more than 16 languages."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    hidden, lanes = hidden or max(8, 2 * math.ceil(math.sqrt(k))), k * -(-lanes // k)
    p = [rng.normal(0, 0.1, (2, PAD + 1, hidden)) for _ in range(3)] + [rng.normal(0, 0.3, (2, hidden, hidden)) for _ in range(3)]
    p += [rng.normal(0, 0.3, (2, hidden, k)), np.zeros(k)]
    p[0] += 0.5
    p[1] += 0.5
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    data = [np.frombuffer(w, np.uint8).astype(np.int64) for w in windows]
    by_label = [[i for i, y in enumerate(labels) if y == c] for c in range(k)]
    for step in range(1, steps + 1):
        codes, y = np.full((span, lanes), PAD), np.empty(lanes, np.int64)
        for lane in range(lanes):
            y[lane] = lane % k
            text = data[by_label[lane % k][rng.integers(len(by_label[lane % k]))]]
            at = rng.integers(max(1, len(text) - span + 1))
            piece = text[at : at + span]
            codes[: len(piece), lane] = piece
        grads = _gradients(p, codes, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for i, g in enumerate(grads):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            now = rate * (1 - step / (steps + 1))
            p[i] = p[i] - now * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    q = [a.astype(np.float32) for a in p]
    return Network(languages, tuple(q[:3]), tuple(q[3:6]), q[6], q[7])


def _gradients(p: list[np.ndarray], codes: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Backpropagation through time of the mean cross entropy over positions that are no padding."""
    (wz, wr, wn, uz, ur, un, wo, bo), (span, lanes) = p, codes.shape
    x, side = _both_ways(codes), np.arange(2)[:, None]
    h, kept = np.zeros((2, lanes, uz.shape[1])), []
    out = np.empty((2, span, lanes, uz.shape[1]))
    for t in range(span):
        a = h @ uz + wz[side, x[t]]
        b = h @ ur + wr[side, x[t]]
        z, r, c = np.clip(a, 0, 1), np.clip(b, 0, 1), h @ un
        e = r * c + wn[side, x[t]]
        n = np.clip(e, -1, 1)
        kept.append((h, a, b, z, r, c, e, n))
        h = n + z * (h - n)
        out[0, t], out[1, span - 1 - t] = h[0], h[1]
    prob = _softmax(out[0] @ wo[0] + out[1] @ wo[1] + bo)
    real = (codes != PAD)[..., None]
    target = np.zeros_like(prob)
    target[:, np.arange(lanes), y] = 1
    d = (prob - target) * real / max(1, real.sum())
    g = [np.zeros_like(a) for a in p]
    for i in range(2):
        g[6][i] = np.einsum("tbh,tbk->hk", out[i], d)
    g[7] = d.sum(axis=(0, 1))
    dout = [d @ wo[0].T, (d @ wo[1].T)[::-1]]
    back = np.zeros_like(h)
    for t in range(span - 1, -1, -1):
        h, a, b, z, r, c, e, n = kept[t]
        dh = back + np.stack([dout[0][t], dout[1][t]])
        dz = dh * (h - n) * ((a > 0) & (a < 1))
        dn = dh * (1 - z) * (np.abs(e) < 1)
        dr, dc = dn * c * ((b > 0) & (b < 1)), dn * r
        back = dh * z + dz @ uz.transpose(0, 2, 1) + dr @ ur.transpose(0, 2, 1) + dc @ un.transpose(0, 2, 1)
        ht = h.transpose(0, 2, 1)
        g[3] += ht @ dz
        g[4] += ht @ dr
        g[5] += ht @ dc
        for i in range(2):
            np.add.at(g[0][i], x[t, i], dz[i])
            np.add.at(g[1][i], x[t, i], dr[i])
            np.add.at(g[2][i], x[t, i], dn[i])
    return g


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """(documents, languages): mean over all positions; zeros for empty texts."""
    total = np.zeros((len(texts), len(net.languages)))
    sizes = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), -(-sizes // CORE))
    first = np.concatenate([np.arange(0, n, CORE) for n in sizes]) if len(texts) else np.zeros(0, np.int64)
    edge = bytes(WARM)
    padded = [np.frombuffer(edge + t + edge, np.uint8) for t in texts]
    length = np.minimum(CORE, sizes[doc] - first)
    order = np.argsort(length, kind="stable")  # lanes of like length share a block
    wide = max(1, LANES * 4 // max(4, len(net.languages)))  # probabilities of a block stay as large for any number of languages
    for lo in range(0, len(order), wide):
        lanes = order[lo : lo + wide]
        span = int(length[lanes].max()) + 2 * WARM
        codes = np.full((span, len(lanes)), PAD, np.int16)
        for j, w in enumerate(lanes):
            at, n = int(first[w]), int(sizes[doc[w]])
            piece = padded[doc[w]][at : at + span]
            codes[: len(piece), j] = piece
            codes[: max(0, WARM - at), j] = PAD
            codes[max(0, n + WARM - at) :, j] = PAD
        prob = position_probabilities(net, codes)[WARM:]
        inside = np.arange(len(prob))[:, None] < length[lanes][None, :]
        pooled = np.einsum("tbk,tb->bk", prob, inside.astype(np.float32))
        np.add.at(total, doc[lanes], pooled)
    return total / np.maximum(sizes, 1)[:, None]


def fit(docs: DataFrame, text: str, lang: str, order: Column, *, per_language: int = 400, chars: int = 1500, pieces: int = 3, texts: int = 25_600, **how: int) -> Network:
    """Train on a bounded sample of every label: the first ``per_language`` different texts in the order of a hash (16 at least,
    fewer than ``per_language`` where all labels together would have more than ``texts``), of longer texts ``pieces`` at hashed
    places of the whole text, ``chars`` characters together. Rows with null text or label take no part; without any label
    there is nothing to tell apart, and the network knows no language.

    A label's texts are first thinned by a bound on the hash, set from the label's count, so what is sorted for a label does
    not grow with the table or its number of tasks.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("l"), order.alias("o"), F.col(text).alias("t"))
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}  # the network has an output for each label anyway
    names = sorted(counts)
    if not names:
        return Network((), (), (), np.zeros((2, 0, 0)), np.zeros(0))
    per_language = min(per_language, max(16, texts // len(names)))
    mark = F.xxhash64("o", "t")
    bound = [(1 << 63) - 1 if counts[x] <= 8 * per_language else int((1 << 64) * 4 * per_language / counts[x]) - (1 << 63) for x in names]
    bounds = docs.sparkSession.createDataFrame(pa.table({"l": pa.array(names, pa.string()), "bound": pa.array(bound, pa.int64())}))  # of a list, executors would start Python processes for it
    thin = rows.withColumn("m", mark).join(F.broadcast(bounds), "l").where("m <= bound")  # a row per label
    n, size = F.length("t"), chars // pieces
    places = [(F.pmod(F.xxhash64("o", n, F.lit(i)), n - size + 1) + 1).cast("int") for i in range(pieces)]
    piece = F.when(n <= chars, F.col("t")).otherwise(F.concat_ws("\n", *[F.substring(F.col("t"), at, F.lit(size)) for at in places]))
    short = thin.select("l", "m", piece.alias("t")).distinct()
    sample = sorted((r["l"], r["m"], r["t"]) for r in top_rows(short, ["l"], [F.col("m"), F.col("t")], per_language).collect())
    number = {x: i for i, x in enumerate(names)}
    return train([t.encode() for _, _, t in sample], [number[x] for x, _, _ in sample], tuple(names), **how)


def predict(docs: DataFrame, text: str, net: Network, *, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` with the predicted language and its probability.

    Null texts and texts without a letter get ``und`` and score 0, and so do all where the network knows no language. Ties go to
    the language that sorts first. Repeated rows are answered alike; columns of the same names as the two new ones are
    replaced. An empty table stays empty.
    """
    if not net.languages:
        return docs.drop(lang_col, score_col).withColumn(lang_col, F.lit(UNKNOWN)).withColumn(score_col, F.lit(0.0))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for lo, hi in _slices(column):
                texts = [x.as_py() or b"" for x in column.slice(lo, hi - lo)]
                prob = document_probabilities(net, texts)
                best = prob.argmax(axis=1)
                answer = pa.array([net.languages[i] for i in best])
                score = pa.array(np.clip(prob[np.arange(len(best)), best], 0, 1))
                rest = batch.slice(lo, hi - lo).select(range(1, batch.num_columns))
                yield pa.RecordBatch.from_arrays([*rest.columns, answer, score], names=[*rest.schema.names, "__lang", "__score"])

    small_batches(docs.sparkSession)
    kept = docs.drop(lang_col, score_col)
    inner = [f"c{i}" for i in range(len(kept.columns))]
    at = kept.columns.index(text)
    letters = F.coalesce(F.col(inner[at]).rlike(r"\p{L}"), F.lit(False))
    plain = kept.toDF(*inner).withColumn("__letters", letters)
    bytes_first = plain.select(F.when(F.col("__letters"), F.col(inner[at]).cast("binary")).alias("__bytes"), *inner, "__letters")
    types = ", ".join([f"{n} {kept.schema[i].dataType.simpleString()}" for i, n in enumerate(inner)] + ["__letters boolean", "__lang string", "__score double"])
    done = bytes_first.mapInArrow(label, types)
    return done.select(
        *[F.col(n).alias(c) for n, c in zip(inner, kept.columns)],
        F.when(F.col("__letters"), F.col("__lang")).otherwise(F.lit(UNKNOWN)).alias(lang_col),
        F.when(F.col("__letters"), F.col("__score")).otherwise(F.lit(0.0)).alias(score_col),
    )


def _slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Cut a batch so that the texts of a cut hold about ``most`` bytes (one text at least)."""
    lo, held = 0, 0
    for i, x in enumerate(column):
        held += len(x.as_py() or b"")
        if held >= most:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(column):
        yield lo, len(column)
