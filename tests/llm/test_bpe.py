import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fencegraph.llm import bpe

HOW = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
LETTERS = st.text(alphabet=st.sampled_from(list("ab'sT1 2 \n\t 　\x1c\x85é.,<|>-")) | st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=400, deadline=None)
@given(LETTERS)
def test_cells_encode_as_the_whole_text(text):
    c = bpe.codec(*HOW)
    assert "".join(bpe.cells(text)) == text
    whole = c.library.encode_ordinary(text)
    assert c.encode(text).tolist() == whole
    assert c.decode(whole) == text.encode()


@pytest.mark.parametrize("chunk, overlap", [(32768, 1024), (40, 12), (7, 3)])
def test_chunks_are_stitched_without_a_trace(spark, monkeypatch, chunk, overlap):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "OVERLAP", overlap)
    texts = [None, "", " ", "a" * 500, "it's we'll  go\n\n  on, " * 40, "x" * 90 + " y" * 90, " " * 200, "é\n" * 120, "1234567890" * 30 + "  \n end", "<|endoftext|> 'S 's " * 9]
    rows = [(i, t, "old") for i, t in enumerate(texts)] + [(3, texts[3], None), (None, "null id here, it's long enough to cut", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.encode(df, "text", *HOW)
    back = bpe.decode(coded, "ids", *HOW).collect()
    library = bpe.codec(*HOW).library
    got = sorted(((r.doc_id, list(r.ids), bytes(r.bytes)) for r in back), key=str)
    assert got == sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows), key=str)


def test_digest_and_empty_table(spark):
    assert bpe.decode(bpe.encode(spark.createDataFrame([], "doc_id long, text string"), "text", *HOW), "ids", *HOW).collect() == []
    got = spark.createDataFrame([([5, 17, 40000],), ([],)], "ids array<int>").select(bpe.ids_digest(F.col("ids")).alias("d")).collect()
    assert [r.d for r in got] == [hashlib.sha256(b"5 17 40000").hexdigest(), hashlib.sha256(b"").hexdigest()]
