"""Cleaning, splitting, chunking, upserts on small texts."""

import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fencegraph.functions import text as X
from fencegraph.operators import prep as P

TERMINAL = re.compile(r"[.!?。！？][\"'”’)\]]?(?=\s|$)")


def spans_of(text):
    out, at = [], 0
    for end in [m.end() for m in TERMINAL.finditer(text)] + [len(text)]:
        piece = text[at:end]
        if piece.strip():
            out.append((at + len(piece) - len(piece.lstrip()), end))
        at = end
    return out


def chunks_of(spans, limit, overlap):
    out, first = [], 0
    while spans:
        last = max([j for j in range(first, len(spans)) if j == first or spans[j][1] - spans[first][0] <= limit])
        out.append((spans[first][0], spans[last][1]))
        if last + 1 == len(spans):
            break
        first = max(first + 1, last + 1 - overlap)
    return out


def got(spark, texts, limit, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, clean_text string")
    df = X.with_chunk_spans(X.with_sentence_spans(df, "clean_text"), "spans", F.lit(limit), F.lit(overlap))
    rows = df.orderBy("id").collect()
    return [([tuple(s) for s in r.spans], [tuple(c) for c in r.chunk_spans]) for r in rows]


def test_sentences_are_exact(spark):
    (spans, _), = got(spark, ["Hello world. Second one! Third?"], 100, 0)
    assert spans == [(0, 12), (13, 24), (25, 31)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .!?\"')]\n。 é", max_size=60), min_size=1, max_size=20), st.integers(1, 30), st.integers(0, 3))
def test_spans_and_chunks_match_a_restatement(spark, texts, limit, overlap):
    for text, (spans, chunks) in zip(texts, got(spark, texts, limit, overlap), strict=True):
        assert spans == spans_of(text)
        assert chunks == chunks_of(spans_of(text), limit, overlap)


def test_long_texts_cross_the_run_length(spark):
    rnd = random.Random(7)
    texts = [" ".join("word" * rnd.randint(1, 4) + rnd.choice([".", "", "!”", ","]) for _ in range(n)) for n in (0, 63, 64, 65, 700)]
    for text, (spans, chunks) in zip(texts, got(spark, texts, 200, 2), strict=True):
        assert spans == spans_of(text) and chunks == chunks_of(spans, 200, 2)


def cleaned(spark, raw, **kw):
    r = P.clean(spark.createDataFrame([(raw,)], "raw_text string"), **kw).collect()[0]
    return r.clean_text, r.removed_lines


def test_cleaning(spark):
    assert cleaned(spark, "Ｈｅｌｌｏ")[0] == "Hello"
    assert cleaned(spark, "long-\nword here.")[0] == "longword here."
    assert cleaned(spark, "long-\nword here.", dehyphenate=False)[0] == "long- word here."
    assert cleaned(spark, "Real line.\n[T/N: a note]\nMore.", cruft=["^\\[t/n:"]) == ("Real line. More.", ["[T/N: a note]"])
    assert cleaned(spark, "Line one.\r\nstill one.\r\n\r\n\r\nPara\ttwo.")[0] == "Line one. still one.\n\nPara two."
    assert cleaned(spark, "Line one.\nstill one.", newline_is_paragraph=True)[0] == "Line one.\n\nstill one."


def detect(spark, raw, **kw):
    rows = P.detect(spark.createDataFrame([(1, raw)], "work_id long, raw_text string"), **kw).orderBy("src_pos").collect()
    return [(r.ordinal, r.title, r.raw_text) for r in rows]


def test_detection_modes(spark):
    book = "lost words\nChapter 4: Alpha\nbody a\n\n  CHAPTER 9\nbody b"
    assert detect(spark, book, mode="heading") == [(4, "Chapter 4: Alpha", "\nbody a\n"), (9, "CHAPTER 9", "\nbody b")]
    assert detect(spark, book) == detect(spark, book, mode="heading")
    assert detect(spark, "first part\n---\n  \n---\nsecond part") == [(1, None, "first part"), (2, None, "second part")]
    assert detect(spark, "no marks", first=5) == [(5, None, "no marks")]
    assert detect(spark, book, mode="file") == [(1, None, book)]


def test_leading_heading(spark):
    rows = [(" \n\nChapter 2: The Heron\nbody\nmore",), ("The body\nChapter 3",), ("\n\n",)]
    df = P.leading_heading(spark.createDataFrame(rows, "t string"), "t", F.lit("stem"))
    assert sorted((r.title, r.body) for r in df.collect()) == [("Chapter 2: The Heron", "body\nmore"), ("stem", "\n\n"), ("stem", "The body\nChapter 3")]


def test_ordinals_and_empties(spark):
    df = spark.createDataFrame([(1, 0, 3, ""), (1, 1, 3, "x"), (1, 2, 4, "y")], "work_id long, src_pos int, ordinal int, clean_text string")
    kept, dup = P.first_per_ordinal(df)
    assert [r.src_pos for r in dup.collect()] == [1]
    full, empty = P.drop_empty(kept)
    assert [r.ordinal for r in full.collect()] == [4] and [r.ordinal for r in empty.collect()] == [3]


def test_second_ingest_changes_nothing(spark):
    src = spark.createDataFrame([(1, "Chapter 1\nOne. Two.\nChapter 2\nThree.")], "work_id long, raw_text string")
    ch = P.as_chapters(P.clean(P.detect(src)))
    empty = ch.filter("false")
    assert {r.action for r in P.diff_chapters(ch, empty).collect()} == {"added"}
    stored = P.upsert_chapters(ch, empty)
    assert {r.action for r in P.diff_chapters(ch, stored).collect()} == {"unchanged"}
    assert stored.count() == 2
