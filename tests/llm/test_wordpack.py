import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fencegraph.llm import wordpack

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 3, 500, 49407, 2**30, 2**60 - 1, 2**60, 2**64 - 1]) | st.integers(0, 2**64 - 1), max_size=700))
def test_words_hold_any_ids(values):
    ids = np.array(values, np.uint64)
    assert wordpack.unpack(wordpack.pack(ids)).tolist() == values


def test_blocks_are_decoded_alone():
    rng = random.Random(1)
    ids = np.array([rng.choice([0, 1, rng.randrange(1 << rng.randrange(1, 64))]) for _ in range(3 * wordpack.BLOCK + 17)], np.uint64)
    data = wordpack.pack(ids)
    for first, last in ((0, 1), (1, 3), (3, 4), (2, None), (4, 9)):
        stop = len(ids) if last is None else last * wordpack.BLOCK
        assert (wordpack.unpack(data, first, last) == ids[first * wordpack.BLOCK : stop]).all()
    tokens = np.array([rng.randrange(49408) for _ in range(10000)], np.uint64)
    assert len(wordpack.pack(tokens)) < 3 * len(tokens)
    with pytest.raises(ValueError):
        wordpack.unpack(b"x" * 64)


WORDS = st.text(alphabet=st.sampled_from(list("abTi'ds.,!1 \n\té́Σİ <|>")) | st.characters(exclude_categories=["Cs"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=5))
def test_words_encode_as_whole_texts(texts):
    texts = [*texts, "<|endoftext|>. a<|STARTOFTEXT|>b <|endoftext|>"]
    c = wordpack.coder(PATH)
    assert [x.tolist() for x in c.encode(texts, 1)] == [c.library.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_files_hold_documents_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wordpack, "SEGMENT", 64)
    rng = random.Random(2)
    texts = [None, "", "   ", "Hello, world." * 30] + [" ".join(rng.choice(["Tree", "the", "forêt,", "it's", "42"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(rng.randrange(10**12) - 5, t, "x") for t in texts] + [(7, "b", "x"), (7, "a", "x"), (7, "a", "x"), (None, "null id", "x")]
    path = str(tmp_path / "ids")
    wordpack.write(spark.createDataFrame(rows, "doc_id long, text string, start string"), "doc_id", "text", PATH, path)
    library, at, want = Tokenizer.from_file(PATH), 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in wordpack.read(spark, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    files = sorted(spark.read.parquet(path).collect(), key=lambda r: (r.shard, r.number))
    order = [i for f in files for i in f.docs]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "none")
    wordpack.write(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", PATH, path)
    assert wordpack.read(spark, path).collect() == []
