"""Benchmark decontamination: rare 2-gram seeds join passages to items, then Smith-Waterman alignment of words.

The local alignment of an item and a passage (match 1, mismatch and gap -1) scores copies with words changed, dropped or added;
its share of the item's words is the score. A leak reaches the item's bar b (``bar_of``, rounded up).

Which seeds lose nothing: an alignment of M matches and E edits scores M - E >= b. Between neighbouring matches lie M - 1 gaps, and
an edit spoils one of them at most, so b - 1 pairs of neighbouring words of the item stand side by side in the passage too,
wherever words were changed, dropped or added. Of the n - 1 pairs of an item the n - b + t that are rarest in the corpus are
seeds; t of them at least are in every leak (t = 3, or b - 1 where that is less; items of one word have that word as seed).

Passages are scanned where they lie: once to count the items' pairs over all documents, once for the places of seeds, through
bitmaps of bounded size. What passes is joined with the seeds; documents in which t seeds of an item meet are aligned with it,
once for each different text, in windows that hold any alignment through a seed. So a benchmark may be of any size: it is never
collected or broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fencegraph.functions.lineage import cut
from fencegraph.llm.bytewords import Bytes, mix, words_between
from fencegraph.llm.sieve import Sieve, sieve

LEAST_SCORE, LEAST_WORDS, LEAST_SHORT = 0.5, 8, 0.75
SEEDS_MET = 3
CHUNK = 1 << 20  # bytes of text scanned at once
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_ODD = re.compile("[ -¿ -⁯　-〿]")
# Scripts without blanks (Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han): every letter or mark is a word.
_UNPARTED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")


def plain(text: str) -> bytes:
    """Lower-cased words, parted by blanks: runs of letters and digits (and whatever else is neither ASCII nor common
    punctuation); single characters in scripts that put no blanks between words."""
    text = text.lower()
    if not text.isascii():
        text = _UNPARTED.sub(r" \g<0> ", _ODD.sub(" ", text))
    return text.encode("utf-8", "surrogatepass").translate(_TABLE)


def words_of(text: str) -> list[bytes]:
    return plain(text).split()


@lru_cache(maxsize=4096)
def _item_words(text: str) -> list[bytes]:
    return words_of(text)


def grams(texts: list[bytes], singles: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of all pairs of neighbouring words of plain texts and, with ``singles``, of all words."""
    b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    line = b == 10
    start, end = words_between(line | (b == 32))
    word = Bytes(b).hashes(start, end, 0)
    lines = np.flatnonzero(line)
    doc = np.searchsorted(lines, start)
    place = np.arange(len(start)) - np.searchsorted(start, np.concatenate([[0], lines[:-1] + 1]))[doc] if len(start) else doc
    both = np.flatnonzero(doc[1:] == doc[:-1])
    pair = mix(word[both] * np.uint64(0x9E3779B97F4A7C15) + word[both + 1])
    if not singles:
        return doc[both], place[both], pair
    return np.concatenate([doc[both], doc]), np.concatenate([place[both], place]), np.concatenate([pair, mix(~word)])


def _chunks(batches: Iterator[pa.RecordBatch], at: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of a batch with their plain texts, about ``CHUNK`` bytes at a time."""
    for batch in batches:
        lo, held = 0, []
        for i, x in enumerate(batch.column(at)):
            held.append(plain(x.as_py() or ""))
            if sum(map(len, held[-64:])) > CHUNK // 64 and sum(map(len, held)) >= CHUNK:
                yield batch.slice(lo, len(held)), held
                lo, held = i + 1, []
        if held:
            yield batch.slice(lo, len(held)), held


def bar_of(n: int) -> float:
    """The least score that makes a leak of an item of ``n`` words: half of them; 8 for 11 to 15, three quarters for 9 and 10
    (one word changed), all for fewer."""
    return float(n) if n <= LEAST_WORDS else max(LEAST_SCORE * n, min(LEAST_WORDS, LEAST_SHORT * n))


def _seeds_met(n: Column) -> Column:
    """So many seeds of an item of ``n`` words meet in every leak of it, at least."""
    return F.least(F.lit(SEEDS_MET), F.greatest(F.lit(1), _whole_bar(n) - 1))


def _seeds_needed(n: Column) -> Column:
    """So many of its rarest pairs are an item's seeds."""
    return F.least(F.greatest(F.lit(1), n - 1), n - _whole_bar(n) + _seeds_met(n))


def _whole_bar(n: Column) -> Column:
    """``bar_of``, rounded up."""
    return F.ceil(F.when(n <= LEAST_WORDS, n.cast("double")).otherwise(F.greatest(n * LEAST_SCORE, F.least(F.lit(float(LEAST_WORDS)), n * LEAST_SHORT))))


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of ``item`` (m, word numbers) with each row of ``windows`` (b, w): score, begin and end in the
    row. The earliest end wins a tie, then the earliest begin.

    A cell is one number: the score above, w + 1 minus the place where the alignment begins below, so that maxima carry it
    along. Gaps in the item are taken by a running maximum, so a row of the table costs a few vector operations.
    """
    b, w = windows.shape
    unit = np.int64(1 << 32)
    place = np.arange(w + 1, dtype=np.int64)
    fresh = w + 1 - place  # score 0, beginning at the next word
    gap = place * unit
    before = np.broadcast_to(fresh, (b, w + 1)).copy()
    best, end = np.full(b, fresh[0]), np.zeros(b, np.int64)
    for word in item:
        now = np.empty_like(before)
        now[:, 0] = fresh[0]
        np.add(before[:, :-1], np.where(windows == word, unit, -unit), out=now[:, 1:])
        np.maximum(now, before - unit, out=now)
        np.maximum(now, fresh, out=now)
        now += gap
        np.maximum.accumulate(now, axis=1, out=now)
        now -= gap
        np.maximum(now, fresh, out=now)
        at = now.argmax(axis=1)
        top = now[np.arange(b), at]
        better = (top // unit > best // unit) | ((top // unit == best // unit) & (at < end))
        best, end = np.where(better, top, best), np.where(better, at, end)
        before = now
    return best // unit, w + 1 - best % unit, end


def leak_of(words: list[bytes], item: list[bytes], spots: list[int], here: set[bytes] | None = None) -> tuple[float, int, int] | None:
    """(score, first word, word after the last) of the best alignment of an item with the words, in windows at ``spots`` (place in
    the words less place in the item, in steps of the item's length); None below the bar."""
    distinct, bar = set(item), bar_of(len(item))
    repeats = len(item) - len(distinct)
    if repeats + len(distinct & (set(words) if here is None else here)) < bar:
        return None  # a score is at most the number of the item's words that are there
    size, slack = step_of(len(item)), len(item) // 2 + 4  # no leak has more edits than half of the item's words
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    wide = 2 * size + 2 * slack
    best = (-1, 0, 0)
    spans = [s for s in sorted(spots) if repeats + len(distinct.intersection(words[max(0, s * size - slack) : max(0, s * size - slack) + wide])) >= bar]
    for lo in range(0, len(spans), 256):
        windows = np.full((len(spans[lo : lo + 256]), wide), -1, np.int32)
        begins = []
        for row, s in enumerate(spans[lo : lo + 256]):
            begin = max(0, s * size - slack)
            begins.append(begin)
            piece = words[begin : begin + wide]
            windows[row, : len(piece)] = [number.get(w, -1) for w in piece]
        score, first, last = align(np.array([number[w] for w in item]), windows)
        for s, f, e, begin in zip(score.tolist(), first.tolist(), last.tolist(), begins):
            best = max(best, (s, -(begin + f), -(begin + e)))
    return (best[0] / len(item), -best[1], -best[2]) if best[0] >= bar else None


def step_of(n: int) -> int:
    return max(n, LEAST_WORDS)


_LEAKS = "array<struct<item_id:bigint,score:double,first:int,stop:int>>"
_KEY = ["k1", "k2"]  # 128 bits of a text


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(ikey, i, t, n, grams): different items with a word, their number of words and the hashes of their pairs in order."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunks(batches, "t"):
            doc, _, h = grams(texts, singles=False)
            n = np.array([len(t.split()) for t in texts])
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
            lists = [h[ends[j] : ends[j + 1]] if n[j] != 1 else grams([t], singles=True)[2] for j, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array([x.view(np.int64).tolist() for x in lists], pa.list_(pa.int64()))], names=["i", "t", "n", "grams"])

    return items.mapInArrow(work, "i long, t string, n long, grams array<long>").where("n > 0").withColumn("ikey", F.monotonically_increasing_id())


def _seeds(texts: DataFrame, items: DataFrame, singles: bool) -> DataFrame:
    """(h, ikey, n, places): the seeds of the items by hash. Pairs are counted over all documents first."""
    every = items.select("ikey", "n", F.posexplode("grams").alias("p", "h"))
    sent = texts.sparkSession.sparkContext.broadcast(sieve(every.select("h").distinct(), "h"))  # a bounded bitmap

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def added() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "c"])

        for _, plain_texts in _chunks(batches, "text"):
            h = grams(plain_texts, singles)[2]
            held.append(h[sent.value.holds(h)])
            if sum(map(len, held)) > 1 << 19:
                yield added()
                held = []
        if held:
            yield added()

    counts = texts.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    rarest = Window.partitionBy("ikey").orderBy(F.coalesce("c", F.lit(0)), "p")  # pairs of one item
    ranked = every.join(counts, "h", "left").withColumn("nth", F.row_number().over(rarest)).where(F.col("nth") <= _seeds_needed(F.col("n")))
    return ranked.groupBy("h", "ikey", "n").agg(F.sort_array(F.collect_list("p")).alias("places"))


def _places(texts: DataFrame, seeds: Sieve, singles: bool) -> DataFrame:
    """(k1, k2, q, h): the places of seeds in texts."""
    sent = texts.sparkSession.sparkContext.broadcast(seeds)  # a bounded bitmap

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, plain_texts in _chunks(batches, "text"):
            doc, place, h = grams(plain_texts, singles)
            some = np.flatnonzero(sent.value.holds(h))
            key = [batch.column(k).take(pa.array(doc[some])) for k in _KEY]
            yield pa.RecordBatch.from_arrays([*key, pa.array(place[some]), pa.array(h[some].view(np.int64))], names=[*_KEY, "q", "h"])

    return texts.select(*_KEY, "text").mapInArrow(work, "k1 long, k2 long, q long, h long")


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaks of texts (text, met: array of item id, item text, spots)."""
    for batch in batches:
        out = []
        for text, met in zip(batch.column("text"), batch.column("met"), strict=True):
            words = words_of(text.as_py())
            here, best = set(words), {}
            for m in met.as_py():
                if leak := leak_of(words, _item_words(m["t"]), m["spots"], here):
                    best[m["i"]] = max(best.get(m["i"], (0.0, 0, 0)), (leak[0], -leak[1], -leak[2]))
            out.append([{"item_id": i, "score": s, "first": -f, "stop": -e} for i, (s, f, e) in sorted(best.items())])
        leaks = pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first", pa.int32()), ("stop", pa.int32())])))
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in _KEY], leaks], names=[*_KEY, "leaks"])


def leaks_by_text(texts: DataFrame, benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(k1, k2, leaks) of the texts into which an item leaked; ``texts``: k1, k2, text."""
    spark = texts.sparkSession
    items = cut(_items(benchmark, item_id, item_text), "items")
    nothing = spark.createDataFrame([], f"k1 long, k2 long, leaks {_LEAKS}")
    if items.isEmpty():
        return nothing
    singles = not items.where("n = 1").isEmpty()
    seeds = cut(_seeds(texts, items, singles), "seeds")
    places = _places(texts, sieve(seeds.select("h").distinct(), "h", bits_per_key=128), singles).distinct()
    met = places.join(seeds, "h").withColumn("step", F.greatest(F.col("n"), F.lit(LEAST_WORDS)))
    met = met.select(*_KEY, "ikey", _seeds_met(F.col("n")).alias("least"), "h", F.size("places").alias("held"), F.explode(F.array_distinct(F.transform("places", lambda p: F.floor((F.col("q") - p) / F.col("step")).cast("int")))).alias("spot")).distinct()
    cand = met.groupBy(*_KEY, "ikey").agg(F.collect_set("spot").alias("spots"), F.collect_set(F.struct("h", "held")).alias("hs"), F.first("least").alias("least"))
    cand = cand.where(F.aggregate("hs", F.lit(0), lambda a, x: a + x["held"]) >= F.col("least")).select(*_KEY, "ikey", F.array_sort("spots").alias("spots"))
    cand = cut(cand.join(items.select("ikey", "i", "t"), "ikey").groupBy(*_KEY).agg(F.collect_list(F.struct("i", "t", "spots")).alias("met")), "candidates")
    once = texts.join(cand.select(*_KEY), _KEY, "left_semi").groupBy(*_KEY).agg(F.first("text").alias("text"))
    found = once.join(cand, _KEY).mapInArrow(_aligned, f"k1 long, k2 long, leaks {_LEAKS}")
    return cut(found.where(F.size("leaks") > 0), "leaks")


def find(docs: DataFrame, text: str, benchmark: DataFrame, item_id: str, item_text: str, *, out: str = "leaks") -> DataFrame:
    """All columns of ``docs`` with ``out``: array<struct<item_id, score, first, stop>> in order of item id, empty for clean
    documents (``first`` and ``stop`` count words of the document; of equal alignments the one that begins first counts).

    Null and empty texts are clean; items without a word are in no document; items of up to eight words must be there in
    full, longer ones by ``bar_of``. Repeated rows are answered each, their text is aligned once; an item id with several texts is
    found by any of them. No items, no leaks; an empty table stays empty. Columns of any other name stay.
    """
    kept = docs.drop(out)
    names = [f"c{i}" for i in range(len(kept.columns))]
    body = F.col(names[kept.columns.index(text)])
    keyed = kept.toDF(*names).select(*names, *_key(body))
    texts = kept.toDF(*names).select(*_key(body), body.alias("text")).where("text <> ''")
    leaks = leaks_by_text(texts, benchmark, item_id, item_text)
    none = F.array().cast(_LEAKS)
    return keyed.join(leaks, _KEY, "left").select(*names, F.coalesce("leaks", none).alias("leaks")).toDF(*kept.columns, out)
