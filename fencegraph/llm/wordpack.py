"""Token ids in files of Simple-8b words.

A word has a selector in its top four bits and packs 1 to 240 ids of equal width into the other sixty. One selector is an
escape: the next word is one id of up to 64 bits, raw. Words are filled greedily with as many ids as fit. Every ``BLOCK``
ids start on a word of their own, and a segment begins with the word offset of each block, so any block is decoded alone,
and all words of one selector at once.

A table of segments is the file: each row holds the documents of a run of ids in ascending order with their lengths, and
the packed ids. A document lies in one segment. Rows are written by Spark's own commit, so a lost executor leaves no half file.
"""

from __future__ import annotations

import os
import struct
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from fencegraph.llm.bytewords import Bytes, words_between
from fencegraph.llm.common import small_batches, tasks

# Fixed values of the code: how many ids a word of each selector holds. The width follows. Selector 1 is the escape.
COUNTS = (240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 64) + tuple(60 // n for n in COUNTS[2:])
ESCAPE = 1
BLOCK = 8192
SEGMENT = 1 << 20  # ids after which a segment is closed
REMEMBERED = 400_000  # words in either half
CHUNK = 8 << 20  # bytes of text taken at once
_STOP = np.array([c in b".," for c in range(256)])
_ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
_HEAD = struct.Struct("<4sIQ")  # magic, blocks, ids


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    high = ids >> np.uint64(32)
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    if not high.any():
        return low
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low)


def _selectors(ids: np.ndarray) -> np.ndarray:
    """The selector of the fullest word that may begin at each id and ends within its block."""
    n = len(ids)
    chosen = np.full(n, ESCAPE, np.int8)
    most = {1: _bits(ids).astype(np.int8)}  # by count: bits of the widest of so many ids

    def widest(count: int) -> np.ndarray:
        if count not in most:
            half = count // 2
            a, b = widest(half), widest(count - half)
            most[count] = np.maximum(a[: n - count + 1], b[half:])
        return most[count]

    left = BLOCK - np.arange(n, dtype=np.int32) % BLOCK
    for s in range(15, -1, -1):  # rising counts: the largest that fits is written last
        if s != ESCAPE and COUNTS[s] <= n and np.count_nonzero(most[1] <= WIDTHS[s]) >= COUNTS[s]:
            fits = (widest(COUNTS[s]) <= WIDTHS[s]) & (left[: n - COUNTS[s] + 1] >= COUNTS[s])
            chosen[: len(fits)][fits] = s
    return chosen


def pack(ids: np.ndarray) -> bytes:
    """Unsigned 64-bit ids as one segment."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    selectors = _selectors(ids)
    step, starts, at = np.asarray(COUNTS)[selectors].tolist(), [], 0
    keep = starts.append
    while at < n:
        keep(at)
        at += step[at]
    first = np.array(starts, np.int64)
    chosen = selectors[first]
    place = np.concatenate([[0], np.cumsum(1 + (chosen == ESCAPE))])
    words = np.zeros(place[-1], np.uint64)
    for s in np.unique(chosen):
        here = np.flatnonzero(chosen == s)
        word = np.full(len(here), int(s) << 60, np.uint64)
        if s == ESCAPE:
            words[place[here] + 1] = ids[first[here]]
        elif WIDTHS[s]:
            for slot in range(COUNTS[s]):
                word |= ids[first[here] + slot] << np.uint64(slot * WIDTHS[s])
        words[place[here]] = word
    offsets = place[np.searchsorted(first, np.arange(blocks + 1) * BLOCK)].astype("<u8")
    return _HEAD.pack(b"S8B1", blocks, n) + offsets.tobytes() + words.astype("<u8").tobytes()


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (exclusive) of a segment."""
    magic, blocks, n = _HEAD.unpack_from(data)
    if magic != b"S8B1":
        raise ValueError("no Simple-8b segment")
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(data, "<u8", blocks + 1, _HEAD.size).astype(np.int64)
    words = np.frombuffer(data, "<u8", int(offsets[last] - offsets[first]), _HEAD.size + 8 * (blocks + 1) + 8 * int(offsets[first]))
    selector = (words >> np.uint64(60)).astype(np.int64)
    heads = np.ones(len(words), bool)
    if (selector == ESCAPE).any():  # the word after an escape is raw, whatever its top bits
        raw = -1
        for i in np.flatnonzero(selector == ESCAPE).tolist():
            if i != raw:
                raw = i + 1
                heads[raw] = False
    spot = np.flatnonzero(heads)
    chosen = selector[spot]
    count = np.asarray(COUNTS)[chosen]
    begin = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(chosen):
        here = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            out[begin[here]] = words[spot[here] + 1]
        elif WIDTHS[s]:
            mask = np.uint64((1 << WIDTHS[s]) - 1)
            slots = np.arange(COUNTS[s], dtype=np.int64)
            out[begin[here][:, None] + slots] = (words[spot[here]][:, None] >> (slots * WIDTHS[s]).astype(np.uint64)) & mask
    return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Coder:
    """32-bit ids of texts, by words of a tokenizer that lower-cases and drops white space.

    A text is cut at spaces and line ends, and a new word before a full stop or comma at its end, where the tokenizer's own
    pre-tokens end as well. Lower-case words of letters alone pass the tokenizer's normalisers unchanged and are one
    pre-token each, so they go many at a time to its bare model; all others go through the whole tokenizer one by one.

    Texts are taken a few megabytes at a time: their different words are found by array operations, looked up once each, and
    their ids laid out for every place at once. Words are remembered in two halves: where the newer one is full the older one
    is forgotten, so words that keep occurring stay.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        model = self.library.model
        if hasattr(model, "_resize_cache"):  # words are remembered here, and each is seen once by the model
            model._resize_cache(0)
        self.bare = Tokenizer(model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        letters = byte_letters()
        self.letters = {i: c for i, c in enumerate(letters) if i != 32}  # spaces part words
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.whole = all(c in vocabulary and f"{c}</w>" in vocabulary for c in letters)  # no byte is unknown to the model
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def plain(self, text: str) -> bytes:
        """Lower-cased where the tokenizer would do no more than that, with spaces for line ends."""
        if "<|" not in text and "\u03a3" not in text and "\u0130" not in text and unicodedata.is_normalized("NFC", text):
            text = text.lower()
        return text.encode().replace(b"\n", b" ")

    def encode(self, texts: Iterable[str], end: int) -> Iterator[np.ndarray]:
        """Ids of each text with ``end`` behind."""
        held: list[bytes] = []
        size = 0
        for text in map(self.plain, texts):
            if len(text) > CHUNK:
                yield from self._ids(held, end)
                held, size = [], 0
                yield np.concatenate(self._pieces(text, end))
                continue
            held.append(text)
            size += len(text)
            if size >= CHUNK:
                yield from self._ids(held, end)
                held, size = [], 0
        yield from self._ids(held, end)

    def _pieces(self, text: bytes, end: int) -> list[np.ndarray]:
        """Ids of a long text, cut at spaces."""
        out, lo = [], 0
        while lo < len(text):
            hi = text.find(b" ", lo + CHUNK)
            hi = hi if hi >= 0 else len(text)
            out.append(self._ids([text[lo:hi]], end)[0])
            lo = hi
        return [x[:-1] for x in out[:-1]] + out[-1:]

    def _ids(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        """Ids of texts without line ends, each with ``end`` behind."""
        if not texts:
            return []
        flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        stop = flat == 10
        start, last = words_between(stop | (flat == 32))
        part = np.flatnonzero(_STOP[flat[last - 1]] & (last - start > 1) & _ALNUM[flat[last - 2]])  # words before a full stop or comma
        ends = last[part]
        last[part] -= 1
        start, last = np.insert(start, part + 1, ends - 1), np.insert(last, part + 1, ends)
        packed = Bytes(flat)
        keys, lead, group = np.unique(packed.hashes(start, last, 0), return_index=True, return_inverse=True)
        raw, lead = flat.tobytes(), lead.tolist()
        for i in np.flatnonzero(~packed.equal(start, last, start[lead][group], last[lead][group])).tolist():  # words of one hash
            group[i] = len(lead)
            lead.append(i)
        words = [raw[a:b] for a, b in zip(start[lead].tolist(), last[lead].tolist(), strict=True)]
        ids = self.look_up(words)
        # every line end stands for one more word, whose id is ``end``
        sizes = np.array([len(x) // 4 for x in ids] + [1])
        begin = np.cumsum(sizes) - sizes
        table = np.frombuffer(b"".join(ids) + np.uint32(end).tobytes(), np.uint32)
        line = np.searchsorted(start, np.flatnonzero(stop))  # words before each line end
        at = np.insert(group, line, len(words))
        n = sizes[at]
        stops = np.cumsum(n)
        out = table[np.repeat(begin[at] - (stops - n), n) + np.arange(stops[-1])]
        return np.split(out, stops[line + np.arange(len(line))][:-1])

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of different words."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        got = list(map(known.get, words))
        missing = [i for i, x in enumerate(got) if x is None]
        if before:
            for i in missing:
                if (old := before.get(words[i])) is not None:
                    got[i] = known[words[i]] = old
            missing = [i for i in missing if got[i] is None]
        self._learn({words[i] for i in missing})
        for i in missing:
            got[i] = known[words[i]]
        return got

    def _learn(self, words: set[bytes]) -> None:
        known = self.known
        stopped = [w for w in words if w.endswith((b".", b",")) and w[:-1].decode()[-1:].isalnum()]
        if stopped:
            bare = {w[:-1] for w in stopped} | {b".", b","}
            known.update((w, self.before[w]) for w in bare if w in self.before)
            self._learn((words.difference(stopped) | bare).difference(known))
            known.update((w, known[w[:-1]] + known[w[-1:]]) for w in stopped)
            return
        plain = [w for w in words if w.isalpha() and w.islower()] if self.whole else []  # of bytes: a to z
        rest = list(words.difference(plain))
        self._model(plain, [b" ".join(plain[lo : lo + 128]).decode() for lo in range(0, len(plain), 128)])
        if self.whole:
            strings = [w.decode() for w in rest]
            odd = [w.isalpha() and w.islower() and unicodedata.is_normalized("NFC", w) for w in strings]
            letters = [w for w, o in zip(rest, odd) if o]
            self._model(letters, [b" ".join(letters[lo : lo + 128]).decode("latin-1").translate(self.letters) for lo in range(0, len(letters), 128)])
            rest = [w for w, o in zip(rest, odd) if not o]
        for lo in range(0, len(rest), 4096):
            some = rest[lo : lo + 4096]
            for w, e in zip(some, self.library.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                known[w] = np.array(e.ids, np.uint32).tobytes()

    def _model(self, words: list[bytes], lines: list[str]) -> None:
        """Words and the same words in lines of 128, through the bare model."""
        for lo in range(0, len(lines), 128):
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(lines[lo : lo + 128], add_special_tokens=False)), np.uint32)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            data = ids.tobytes()
            self.known.update(zip(words[lo * 128 : (lo + 128) * 128], map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
    return Coder(path)


def write(docs: DataFrame, doc_id: str, text: str, tokenizer: str, path: str, end: int = 1) -> None:
    """Encode whole texts and write the segments to ``path`` in ascending order of ``doc_id``.

    Null and empty texts hold the end id alone. Rows of a repeated id follow each other, ordered by their text; null ids come
    first. Other columns are ignored; an empty table writes no segment. Ranges of ids are dealt over tasks, each of which writes its segments in order.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, shard, number = coder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = before = 0

        def segment() -> pa.RecordBatch:
            data = pack(np.concatenate(ids))
            sizes = [len(x) for x in ids]
            columns = [[shard], [number], [names], [sizes], [before], [held], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()))], names=_FIELDS)

        def texts() -> Iterator[str]:
            for batch in batches:
                names_ahead.extend(batch.column(0).to_pylist())
                for t in batch.column(1):
                    yield t.as_py() or ""

        names_ahead: deque[int | None] = deque()  # of texts that are read and not yet encoded
        for x in c.encode(texts(), end):
            ids.append(x)
            names.append(names_ahead.popleft())
            held += len(x)
            if held >= SEGMENT:
                yield segment()
                ids, names, held, before, number = [], [], 0, before + held, number + 1
        if ids:
            yield segment()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(tasks(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(work, _TYPES).write.parquet(path)


_FIELDS = ["shard", "number", "docs", "sizes", "before", "n_ids", "data"]
_TYPES = "shard int, number long, docs array<long>, sizes array<long>, before long, n_ids long, data binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids as bytes of little-endian unsigned 32-bit integers) from the files at ``path``."""
    files = spark.read.schema(_TYPES).parquet(path)
    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sums.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))  # a row per writing task

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                docs, sizes = (batch.column(n)[row].as_py() for n in ("docs", "sizes"))
                ids = unpack(batch.column("data")[row].as_py()).astype("<u4")
                ends = np.cumsum(sizes)
                begins = ends - np.array(sizes)
                start = batch.column("start")[row].as_py()
                for lo in range(0, len(docs), 1024):
                    some = range(lo, min(lo + 1024, len(docs)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([docs[i] for i in some], pa.int64()), pa.array(start + begins[lo : lo + 1024]), pa.array([sizes[i] for i in some], pa.int64()), pa.array([ids[begins[i] : ends[i]].tobytes() for i in some], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    placed = files.join(F.broadcast(shards), "shard").select("docs", "sizes", "data", (F.col("shard_start") + F.col("before")).alias("start"))
    return placed.mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")
