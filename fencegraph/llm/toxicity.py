"""Toxicity of texts that hide their words: noisy-channel restoration, then a score of what was restored.

A word that is not plain letters (digits and signs for letters, signs between letters, letters drawn out) and a run of single
letters with spaces between them become a lattice: at each place the letters that may be meant, with the cost of writing them
so. The Viterbi path under a character trigram model of the whole corpus is the restored text. Plain words have one path and
stay as they are.

Each document is restored once and kept as the hashes of its distinct words with their counts. What marks toxic documents is
counted from the labels over words and over stems: a word with documents enough is judged by itself, others by their stem. The lexicon is a table of any size, joined to what a bounded bitmap of it lets pass.
The score is a logistic regression on a document's share of such words.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencegraph.functions.lineage import cut
from fencegraph.llm.common import small_batches
from fencegraph.llm.sieve import Sieve, sieve

# Which letters a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y",
}
SIGN_COST, SKIP_COST, KEEP_COST, PART_COST, REPEAT_COST, DOUBLE_COST = 1.0, 2.0, 7.0, 1.0, 0.5, 5.0
VOWELS, VOWEL_COST = "aeiou", 1.0  # what an asterisk or number sign inside a word may hide
K = 28  # symbols: between words, a to z, any other letter
EVEN_COST = SIGN_COST + math.log(K)  # of a sign and the letter it stands for where all letters are alike
REMEMBERED = 200_000
STEM = 6
_WORD_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in SIGNS) + "“”‘’«»…¿¡–—"
_SPACED = re.compile(r"(?:(?<=\s)|^)(?:[^\W_]|[@$!|+])(?:[ \t]{1,2}(?:[^\W_]|[@$!|+])){2,}(?=[.,;:?]?(?:\s|$))")
_DRAWN = re.compile(r"(.)\1\1")


@lru_cache(maxsize=4096)
def symbol(c: str) -> int:
    """0 for what is no letter; accents are folded."""
    c = unicodedata.normalize("NFD", c.lower())[:1]
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def _symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = _low_symbols()
    out = low[np.minimum(codes, len(low) - 1)]
    return out[(out != 0) | np.concatenate([[True], out[:-1] != 0])] if len(out) else out


@lru_cache(maxsize=1)
def _low_symbols() -> np.ndarray:
    table = np.array([symbol(chr(i)) for i in range(0x24F)] + [27], np.int32)  # beyond Latin: any other letter
    return table


def count_trigrams(docs: DataFrame, text: str) -> np.ndarray:
    """Counts (K, K, K) of all texts; each task sends the trigrams it saw, 21,952 at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K**3, np.int64)
        for batch in batches:
            for x in batch.column(0):
                s = _symbols(" " + (x.as_py() or "") + " ")
                for lo in range(0, max(0, len(s) - 2), 1 << 20):
                    p = s[lo : lo + (1 << 20) + 2]
                    total += np.bincount((p[:-2] * K + p[1:-1]) * K + p[2:], minlength=K**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["gram", "n"])

    out = np.zeros(K**3, np.int64)
    for r in docs.select(F.col(text).alias("t")).mapInArrow(work, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out.reshape(K, K, K)


def costs_of(counts: np.ndarray) -> list[float]:
    """-log P(c | a, b) at (a * K + b) * K + c, interpolated with shorter contexts; even where nothing was counted."""
    three, two, one = counts.astype(float), counts.sum(axis=0).astype(float), counts.sum(axis=(0, 1)).astype(float)
    unigram = (one + 1) / (one.sum() + K)
    bigram = (two + 5 * unigram) / (two.sum(axis=1, keepdims=True) + 5)
    trigram = (three + 5 * bigram[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return (-np.log(trigram)).ravel().tolist()


Choice = tuple[str, float]  # letters written to the restored text, cost
Link = tuple["Link", str] | None  # the path before and the letters of the last step


def lattice(noisy: str, bare: bool = False) -> list[list[Choice]]:
    """Choices place by place. Signs may be letters, be skipped inside a word, or part words; drawn-out letters may be one or
    two; single letters may join over the spaces between them. In a ``bare`` word every sign is a letter."""
    out: list[list[Choice]] = []
    i, noisy = 0, noisy.lower()
    while i < len(noisy):
        c, j = noisy[i], i + 1
        while j < len(noisy) and noisy[j] == c:
            j += 1
        n = j - i
        if c.isspace():
            out.append([(" ", PART_COST), ("", 0.0)])
        elif c in SIGNS:
            meant = [(x * k, SIGN_COST * k + REPEAT_COST * (n > k)) for x in SIGNS[c] for k in range(1, min(n, 2) + 1)]
            out.append(meant if bare else [*meant, (" ", KEEP_COST), *([] if c.isalnum() else [("", SKIP_COST)])])
        elif symbol(c):
            out.append([(c, 0.0 if n == 1 else DOUBLE_COST if n == 2 else REPEAT_COST)] + ([(c * 2, 0.0 if n == 2 else REPEAT_COST)] if n > 1 else []))
        elif c in "*#" and n == 1 and 0 < i < len(noisy) - 1:
            out.append([*((v, VOWEL_COST) for v in VOWELS), (" ", 0.0), ("", SKIP_COST)])
        else:
            out.append([(" ", 0.0), ("", SKIP_COST)])
        i = j
    return out


def viterbi(choices: list[list[Choice]], costs: list[float]) -> str:
    return cheapest(choices, costs)[1]


def cheapest(choices: list[list[Choice]], costs: list[float]) -> tuple[float, str]:
    """Cost and text of the cheapest path: at each place the best path of each pair of last symbols goes on, linked back to where it came from,
    so time and memory are linear in the places. Ties go to the path reached first."""
    best: dict[tuple[int, int], tuple[float, Link]] = {(0, 0): (0.0, None)}
    for place in [*choices, [(" ", 0.0)]]:
        now: dict[tuple[int, int], tuple[float, Link]] = {}
        for (a, b), (spent, link) in best.items():
            for letters, price in place:
                x, y, total = a, b, spent + price
                for c in letters:
                    s = symbol(c)
                    if s == 0 and y == 0:
                        continue  # words are parted once
                    total += costs[(x * K + y) * K + s]
                    x, y = y, s
                if (x, y) not in now or total < now[x, y][0]:
                    now[x, y] = (total, (link, letters) if letters else link)
        best = now
    parts: list[str] = []
    spent, link = min(best.values(), key=lambda v: v[0])
    while link:
        link, letters = link
        parts.append(letters)
    return spent, " ".join("".join(reversed(parts)).split())


class Restorer:
    """Restores words, remembered for a bounded number of them."""

    def __init__(self, costs: list[float]) -> None:
        self.costs = costs
        self.known: dict[str, str] = {}

    def word(self, raw: str) -> str:
        """Restored words, space-joined; plain words lower-cased without outer punctuation."""
        w = raw.strip(_WORD_EDGE)
        if not w.isalpha():
            w = w.strip("!|+(<")
        if w.isalpha() and not _DRAWN.search(w.lower()):
            return w.lower()
        if any(c.isalpha() for c in w):
            return viterbi(lattice(w), self.costs)
        # only signs and digits: nothing else tells that a word is meant, so they must spell better than letters taken evenly
        signs = sum(c in SIGNS and w[max(0, i - 2) : i] != c * 2 for i, c in enumerate(w))
        spent, letters = cheapest(lattice(w, True), self.costs) if signs else (0.0, "")
        return letters if spent < EVEN_COST * signs else ""

    def joined(self, text: str) -> str:
        """The text with its runs of single letters restored."""
        return _SPACED.sub(lambda m: viterbi(lattice(m[0]), self.costs), text)

    def restore(self, text: str) -> str:
        """The whole text, restored."""
        return " ".join(chain.from_iterable(self.words(text)))

    def words(self, text: str) -> Iterator[list[str]]:
        for raw in self.joined(text).split():
            got = self.known.get(raw)
            if got is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[raw] = got = self.word(raw)
            yield got.split(" ") if " " in got else [got] if got else []


def _hash(word: str) -> int:
    """Of its first ``STEM`` letters, so that inflected and compounded forms count together."""
    return zlib.crc32(word[:STEM].encode("utf-8", "surrogatepass")) - (1 << 31)


STEM_BITS = -(1 << 32)


def _key(word: str) -> int:
    """The hash of the stem in the upper half, that of the whole word in the lower, whose last bit is set: a stem alone has 0 there."""
    return _hash(word) << 32 | zlib.crc32(word.encode("utf-8", "surrogatepass")) | 1


class _Hashed(Restorer):
    """Keys of the restored words instead of the words."""

    def __init__(self, costs: list[float]) -> None:
        super().__init__(costs)
        self.hashes: dict[str, list[int]] = {}

    def count(self, text: str) -> Counter[int]:
        out: Counter[int] = Counter()
        raw = Counter(self.joined(text).split())
        for w, n in raw.items():
            got = self.hashes.get(w)
            if got is None:
                if len(self.hashes) >= REMEMBERED:
                    self.hashes.clear()
                self.hashes[w] = got = [_key(x) for x in self.word(w).split()]
            for h in got:
                out[h] += n
        return out


def restored_words(docs: DataFrame, text: str, costs: list[float]) -> DataFrame:
    """``docs`` without its text, with ``words`` (keys of the distinct restored words), ``times`` and ``n_words``."""
    sent = docs.sparkSession.sparkContext.broadcast(costs)  # 21,952 numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _Hashed(sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                counts = [r.count(x.as_py() or "") for x in part.column(0)]
                ends = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
                words = pa.ListArray.from_arrays(ends, pa.array(np.fromiter(chain.from_iterable(counts), np.int64)))
                times = pa.ListArray.from_arrays(ends, pa.array(np.fromiter(chain.from_iterable(c.values() for c in counts), np.int32)))
                n = pa.array([sum(c.values()) for c in counts], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], words, times, n], names=[*part.schema.names[1:], "words", "times", "n_words"])

    kept = docs.drop(text, "words", "times", "n_words")
    names = [f"c{i}" for i in range(len(kept.columns))]
    types = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept.schema)] + ["words array<long>", "times array<int>", "n_words long"])
    return docs.select(docs[text].alias("t"), *[docs[c].alias(n) for n, c in zip(names, kept.columns)]).mapInArrow(work, types).toDF(*kept.columns, "words", "times", "n_words")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all lists, and the list each is in."""
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _own_keys(lists: pa.ListArray, among: Sieve | None, by_stem: bool) -> tuple[np.ndarray, np.ndarray]:
    """Words and, once a document, stems that pass ``among``, or with ``by_stem`` the words whose stem passes; and the document of each."""
    keys, doc = _flat(lists)
    stems = keys & STEM_BITS
    if by_stem:
        some = among.holds(stems.view(np.uint64))
        return keys[some], doc[some]
    own = np.unique(doc << 32 | (stems >> 32) + (1 << 31))
    keys, doc = np.concatenate([keys, (own & 0xFFFFFFFF) - (1 << 31) << 32]), np.concatenate([doc, own >> 32])
    some = among.holds(keys.view(np.uint64)) if among is not None else slice(None)
    return keys[some], doc[some]


def _counted(words: DataFrame, ids: DataFrame, out: str, among: Sieve | None = None, by_stem: bool = False) -> DataFrame:
    """(w, ``out``): in how many of the documents ``ids`` each word and stem occurs; of those that pass ``among`` or, with
    ``by_stem``, of the words whose stem passes.

    Documents whose id passes a bitmap of ``ids`` are added up where they lie. Those that passed and are not among ``ids`` are few;
    an exact join of ids finds them, and what they added is taken off again. So no document's words are shuffled but theirs.
    """
    spark, named = words.sparkSession, words.where("doc_id IS NOT NULL").withColumn("k", F.xxhash64("doc_id"))
    sent = spark.sparkContext.broadcast((sieve(ids.select(F.xxhash64("doc_id").alias("k")), "k", bits_per_key=128), among))  # bounded bitmaps

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, among = sent.value
        held: list[np.ndarray] = []

        def added() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["w", "n"])

        for batch in batches:
            batch = batch.filter(pa.array(wanted.holds(batch.column("k").to_numpy().view(np.uint64))))
            held.append(_own_keys(batch.column("words"), among, by_stem)[0])
            if sum(map(len, held)) > 1 << 21:
                yield added()
                held = []
        if held:
            yield added()

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value[0].holds(batch.column("k").to_numpy().view(np.uint64))))

    counts = named.select("k", "words").mapInArrow(add, "w long, n long")
    id_type = words.schema["doc_id"].dataType.simpleString()
    passed = named.select("k", "row", "doc_id").mapInArrow(passing, f"k long, row long, doc_id {id_type}")
    wrong = cut(passed.join(ids, "doc_id", "left_anti").select("row", F.xxhash64("row").alias("h")), "wrong")
    if not wrong.isEmpty():
        few = spark.sparkContext.broadcast(sieve(wrong, "h"))

        def off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, among = sent.value
            for batch in batches:
                some = wanted.holds(batch.column("k").to_numpy().view(np.uint64)) & few.value.holds(batch.column("h").to_numpy().view(np.uint64))
                batch = batch.filter(pa.array(some))
                keys, doc = _own_keys(batch.column("words"), among, by_stem)
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(doc)), pa.array(keys)], names=["row", "w"])

        extra = named.select("k", "row", F.xxhash64("row").alias("h"), "words").mapInArrow(off, "row long, w long").join(wrong, "row", "left_semi")
        counts = counts.unionAll(extra.select("w", F.lit(-1).cast("long").alias("n")))
    return counts.groupBy("w").agg(F.sum("n").alias(out)).where(F.col(out) > 0)


def lexicon(words: DataFrame, known: DataFrame, *, least: int = 5, z: float = 6.0, ratio: float = 4.0) -> DataFrame:
    """(w, weight): keys of words and stems that mark label 1, in ``least`` documents of it or more, with their log ratio of
    document shares; and with weight 0 words that a marked stem would mark and that fall below ``ratio`` by themselves, in
    ``least`` documents or more. ``known``: doc_id, y.

    Documents of label 1 are counted first, the others for the keys alone that reached ``least`` there.
    """
    nothing = words.sparkSession.createDataFrame([], "w long, weight double")
    labelled = {r.y: r.n for r in words.select("doc_id").join(known, "doc_id").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = labelled.get(1, 0), labelled.get(0, 0)
    if not toxic or not clean:
        return nothing
    marking, plain = known.where("y = 1").select("doc_id"), known.where("y = 0").select("doc_id")

    def scored(counts: DataFrame) -> DataFrame:
        """Of ``w``, ``n1`` and ``n0``, null for none."""
        n1, n0 = F.coalesce("n1", F.lit(0)), F.coalesce("n0", F.lit(0))
        share = (n0 + 1) / (clean + 2)
        return counts.select("w", n1.alias("n1"), n0.alias("n0"), (n1 / toxic / share).alias("r"), ((n1 - toxic * share) / F.sqrt(toxic * share * (1 - share))).alias("z"))

    all_marking = cut(_counted(words, marking, "n1"), "toxic-words")
    often = all_marking.where(F.col("n1") >= least)
    judged = scored(often.join(_counted(words, plain, "n0", sieve(often, "w")), "w", "left"))
    marks = cut(judged.where((F.col("z") >= z) & (F.col("r") >= ratio)).select("w", F.least(F.lit(6.0), F.log("r")).alias("weight")), "marks")
    stem = F.col("w").bitwiseAND(F.lit(STEM_BITS))
    stems = marks.where(stem == F.col("w")).select(F.col("w").alias("s"))
    inside = all_marking.join(_counted(words, plain, "n0", sieve(stems, "s"), by_stem=True), "w", "full").where(stem != F.col("w")).join(stems, stem == F.col("s"), "left_semi")
    cleared = scored(inside).where((F.col("n1") + F.col("n0") >= least) & (F.col("r") < ratio)).select("w", F.lit(0.0).alias("weight"))
    return cut(marks.unionAll(cleared), "lexicon")


def marked(words: DataFrame, marks: DataFrame) -> DataFrame:
    """(row, weight, hits, kinds) of rows that hold marked words: their weights and their number, with repeats, and how many
    different ones. A word is looked up whole, and by its stem where the lexicon does not have it whole. What passes a bitmap
    of the lexicon is joined with it."""
    sent = words.sparkSession.sparkContext.broadcast(sieve(marks, "w"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, doc = _flat(batch.column("words"))
            stems = keys & STEM_BITS
            some = np.flatnonzero(sent.value.holds(keys.view(np.uint64)) | sent.value.holds(stems.view(np.uint64)))
            rows = batch.column("row").to_numpy()[doc[some]]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(keys[some]), pa.array(stems[some]), batch.column("times").flatten().take(pa.array(some))], names=["row", "w", "s", "times"])

    met = words.select("row", "words", "times").mapInArrow(work, "row long, w long, s long, times int")
    whole = marks.select("w", F.col("weight").alias("own"))
    stems = marks.select(F.col("w").alias("s"), F.col("weight").alias("of_stem"))
    met = met.join(whole, "w", "left").join(stems, "s", "left").withColumn("weight", F.coalesce("own", "of_stem")).where("weight > 0")
    return met.groupBy("row").agg(F.sum(F.col("weight") * F.col("times")).alias("weight"), F.sum("times").cast("double").alias("hits"), F.count(F.lit(1)).cast("double").alias("kinds"))


def _features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log1p("weight"), F.log1p("hits"), F.col("kinds"), F.least(F.lit(1.0), 20 * F.col("hits") / n), F.log(n)]


def fit(rows: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the constant. Rows of one label alone give a constant of it."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w = w + np.linalg.solve(h, x.T @ (y - p) - penalty * w)
    return w


def score(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, label: str, learn: Column, *, sample: int = 50_000) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) for every document.

    Labels are learnt from documents where ``learn`` (of ``doc_id``) holds; the lexicon counts all of those, the five weights
    of the regression are fitted to the first ``sample`` by a hash of the id. Null and empty texts have no words and are
    scored alike. An id with two labels is toxic if either is. Without labels of both kinds the score is the share of toxic labels.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    costs = costs_of(count_trigrams(texts, "text"))
    words = cut(restored_words(texts, "text", costs).withColumn("row", F.monotonically_increasing_id()), "words")
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label).alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(learn).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = cut(known, "known")
    hits = marked(words, lexicon(words, known)).withColumnRenamed("row", "__row")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    found = cut(words.select("row", "doc_id", "n_words").join(hits, F.col("row") == F.col("__row"), "left").select("doc_id", "n_words", zero("weight"), zero("hits"), zero("kinds")), "marked")
    fitted = found.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = [tuple(r) for r in fitted.select(*[c.alias(f"x{i}") for i, c in enumerate(_features())], F.col("y").cast("double").alias("y")).collect()]
    data = np.array(rows, float).reshape(len(rows), len(_features()) + 1)
    w = fit(data[:, :-1], data[:, -1]) if len(rows) else np.zeros(len(_features()) + 1)
    linear = sum((c * F.lit(float(v)) for c, v in zip(_features(), w)), F.lit(float(w[-1])))
    return found.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.least(linear, F.lit(30.0)), F.lit(-30.0))))).alias("score"))
