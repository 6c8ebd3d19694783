"""Phrase collocation mining by SON partitioning.

The documents of each language are dealt into a few shards. A phrase that occurs ``least`` times in all occurs, in one shard at
least, that shard's share of ``least`` times; so each shard is mined completely at its share (of the language's bytes, rounded
up), the phrases that are frequent somewhere are united, and those candidates alone are counted over all documents.

Inside a shard mining goes by length: phrases of k words are counted only where both their parts of k - 1 words are frequent in
the shard. What is frequent is handed on as a bitmap of hashes, of bounded size. A bitmap may let through a phrase that is not
frequent, never hold one back, and the last count compares the words themselves, so counts are exact for any hash and bitmap.

Texts are cut up as whole byte arrays: words, neighbours and hashes of a few megabytes are found by array operations, equal phrases
of a piece are added up there, and only a row per different phrase is shuffled.

Texts are lower-cased in A-Z, cut into pieces at `.,;:!?` and line ends, and pieces into words at blanks and tabs. Null texts are
empty; null languages are ``und``, as is the language of that name. Repeated rows count as often as they occur. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencegraph.functions.lineage import cut
from fencegraph.functions.ranking import top_rows
from fencegraph.llm.bytewords import Bytes, mix, words_between
from fencegraph.llm.sieve import MOST_BITS, Sieve, sieve

UNKNOWN = "und"
SHARDS = 4  # at most 4: a key's two lowest bits name its shard
CHUNK = 8 << 20  # bytes of text worked on at once
ENDS = b".,;:!?\n\x0b\x0c\r"
_END = re.compile(b"[" + re.escape(ENDS) + b"]")
_TABLE = bytes(10 if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Words:
    """Words of a few texts of one language, as places in one byte array in which single blanks part neighbours."""

    def __init__(self, texts: list[bytes]) -> None:
        b = np.frombuffer(b"\n".join(texts).translate(_TABLE), np.uint8)
        blank = b == 32
        part = blank | (b == 10)
        doubled = blank.copy()
        doubled[1:] &= part[:-1]
        if doubled.any():
            b, part = b[~doubled], part[~doubled]
        self.start, self.end = words_between(part)
        self.text = Bytes(b)
        self.next = (self.start[1:] == self.end[:-1] + 1) & (self.text.data[self.end[:-1]] == 32)  # the following word is a neighbour

    def runs(self, size: int) -> np.ndarray:
        """Whether ``size`` words from each on are neighbours."""
        n = max(0, len(self.start) - size + 1)
        ok = np.ones(n, bool)
        for i in range(size - 1):
            ok &= self.next[i : i + n]
        return ok

    def counted(self, first: np.ndarray, size: int, keys: np.ndarray) -> tuple[list[bytes], np.ndarray, Counter]:
        """Different phrases of ``size`` words from ``first`` on, with their counts; in the Counter what shares its key with
        another phrase."""
        start, end = self.start[first], self.end[first + size - 1]
        order = np.argsort(keys, kind="stable")
        new = np.concatenate(([True], np.diff(keys[order]) != 0)) if len(order) else np.zeros(0, bool)
        group, lead = np.cumsum(new) - 1, order[new]
        alike = lead[group]
        same = self.text.equal(start[order], end[order], start[alike], end[alike])
        raw = self.text.data.tobytes()
        odd = Counter(raw[start[i] : end[i]] for i in order[~same].tolist())
        return [raw[s:e] for s, e in zip(start[lead].tolist(), end[lead].tolist(), strict=True)], np.bincount(group[same], minlength=len(lead)), odd


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Words]]:
    """Words of texts of about CHUNK bytes, by all columns but the text (the first). Longer texts are cut where a piece ends."""
    held: dict[tuple, list[bytes]] = {}
    size = 0
    for batch in batches:
        groups = list(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True))
        for group, value in zip(groups, batch.column(0), strict=True):
            text, lo = value.as_py(), 0
            while lo < len(text):
                stop = _END.search(text, lo + CHUNK) if len(text) - lo > CHUNK else None
                hi = stop.end() if stop else len(text)
                held.setdefault(group, []).append(text[lo:hi])
                size, lo = size + hi - lo, hi
                if size >= CHUNK:
                    for g, texts in held.items():
                        yield g, Words(texts)
                    held, size = {}, 0
    for g, texts in held.items():
        yield g, Words(texts)


def _keyed(words: Words, lang: str, shard: int, longest: int, sieves: list[Sieve]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, first words, keys) of phrases up to ``longest`` words, of which all parts of each shorter size pass its sieve."""
    word = words.text.hashes(words.start, words.end, xxhash.xxh64_intdigest(lang.encode()))
    h = word
    passed = np.ones(0, bool)
    for size in range(1, longest + 1):
        n = max(0, len(word) - size + 1)
        ok = words.runs(size)
        if size > 1:
            h = mix(h[:n] * np.uint64(0x9E3779B97F4A7C15) + word[size - 1 :])
            ok &= passed[:n] & passed[1 : n + 1]
        first = np.flatnonzero(ok)
        keys = (h[first] & ~np.uint64(3)) | np.uint64(shard)
        yield size, first, keys
        if size <= len(sieves):
            passed = np.zeros(n, bool)
            passed[first] = sieves[size - 1].holds(keys)


def mine(dealt: DataFrame, size: int, sieves: list[Sieve]) -> DataFrame:
    """Keys of phrases of ``size`` words that are frequent in a shard (two lowest bits: the shard). ``dealt``: text, lang, shard, least."""
    sent = dealt.sparkSession.sparkContext.broadcast(sieves)  # bounded bitmaps

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, shard, least), words in _chunks(batches):
            for length, _, keys in _keyed(words, lang, shard, size, sent.value):
                if length == size and len(keys):
                    keys, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(np.full(len(n), least, np.int64))], names=["key", "n", "least"])

    counted = dealt.select("text", "lang", "shard", "least").mapInArrow(count, "key long, n long, least long")
    return cut(counted.groupBy("key").agg(F.sum("n").alias("n"), F.min("least").alias("least")).where("n >= least").select("key"), "frequent")


def counts(docs: DataFrame, text: str, lang: str, *, longest: int = 3, least: int = 10, shards: int = SHARDS, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, size, phrase, f): all phrases up to ``longest`` words that occur ``least`` times in a language, exactly counted; with
    size 0 the number of all words."""
    rows = docs.select(F.col(text).cast("binary").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang")).where("length(text) > 0")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(min(shards, SHARDS))).cast("int"))
    sizes = rows.groupBy("lang", "shard").agg(F.sum(F.length("text")).alias("bytes"))
    whole = sizes.groupBy("lang").agg(F.sum("bytes").alias("all"))
    share = F.ceil(F.lit(least) * F.col("bytes").cast("decimal(38,0)") / F.col("all")).cast("long")
    bars = cut(sizes.join(whole, "lang").select("lang", "shard", F.greatest(share, F.lit(1)).alias("least")), "bars")
    dealt = rows.join(bars, ["lang", "shard"]).select("text", "lang", "shard", "least")
    sieves: list[Sieve] = []
    candidates: list[Sieve] = []
    for size in range(1, longest + 1):
        keys = mine(dealt, size, sieves)
        sieves.append(sieve(keys, "key", most_bits))
        candidates.append(sieve(keys.select(F.col("key").bitwiseAND(F.lit(-4)).alias("key")).distinct(), "key", most_bits))
    sent = docs.sparkSession.sparkContext.broadcast(candidates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(lang: str, size: int, phrases: list[bytes], n) -> pa.RecordBatch:
            k = len(phrases)
            return pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([size] * k, pa.int32()), pa.array(phrases, pa.binary()), pa.array(n, pa.int64())], names=["lang", "size", "phrase", "n"])

        for (lang,), words in _chunks(batches):
            yield out(lang, 0, [b""], [len(words.start)])
            for size, first, keys in _keyed(words, lang, 0, longest, sent.value):
                keep = sent.value[size - 1].holds(keys)
                phrases, n, odd = words.counted(first[keep], size, keys[keep])
                for lo in range(0, len(phrases), 50_000):
                    yield out(lang, size, phrases[lo : lo + 50_000], n[lo : lo + 50_000])
                if odd:
                    yield out(lang, size, list(odd), list(odd.values()))

    found = rows.select("text", "lang").mapInArrow(count, "lang string, size int, phrase binary, n long")
    return cut(found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0)).withColumn("phrase", F.col("phrase").cast("string")), "phrases")


def _quotient(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a^2 / (left right)) in decimals of 38 digits."""
    d = "decimal(19,0)"
    return F.floor(F.expr(f"(CAST(a AS {d}) * CAST(a AS {d}) * CAST(1000000 AS decimal(7,0))) div (CAST(l AS {d}) * CAST(r AS {d}))")).cast("long")


def collocations(docs: DataFrame, text: str, lang: str, *, longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``top`` phrases of 2 to ``longest`` words of each language.

    A phrase is cut after its k-th word where floor(1000000 a^2 / (l r)) is lowest, ties to the smallest k. Phrases that lie
    inside a longer candidate with ``percent`` of their count are left out. Order: score, then count, both falling, then
    the bytes of the phrase.
    """
    all_counts = counts(docs, text, lang, longest=longest, least=least, **how)
    known = all_counts.where("size > 0").select("lang", "phrase", "f")
    cand = all_counts.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("w"))
    cuts = cand.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"))
    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).withColumn("score", _quotient(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    inner = cand.where("size > 2").select("lang", F.col("a").alias("b"), "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("len"))
    inner = inner.select("lang", "b", "w", "len", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("len") + 1)).alias("from")).select("lang", "b", F.array_join(F.expr("slice(w, from, len)"), " ").alias("phrase"))
    inside = inner.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("b").isNull() | (100 * F.col("b") < percent * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    few = top_rows(kept.withColumn("lane", F.pmod(F.xxhash64("phrase"), F.lit(64))), ["lang", "lane"], order, top).drop("rank", "lane")
    totals = all_counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return top_rows(few, ["lang"], order, top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
