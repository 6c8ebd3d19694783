"""Text expressions: normal forms, cleaning, sentence spans, chunk spans."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fencegraph import vocab
from fencegraph.functions.arrays import running_starts

# --- fixed values: every whitespace character, sentence terminators and closing marks ---
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
TERMINATORS = "[.!?。！？]"
CLOSERS = "[\"'”’)\\]]"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc_casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def decode_utf8(blobs: pd.Series) -> pd.Series:
    """UTF-8 with undecodable bytes replaced."""
    return blobs.map(lambda b: bytes(b).decode("utf-8", errors="replace"), na_action="ignore")


def strip_ws(s: Column) -> Column:
    return F.regexp_replace(s, f"^{WS}+|{WS}+\\z", "")


def squeeze(s: Column) -> Column:
    """Runs of whitespace become one space; ends trimmed."""
    return F.trim(F.regexp_replace(s, f"{WS}+", " "))


def sha256(s: Column) -> Column:
    return F.sha2(s.cast("binary"), 256)


def slugify(s: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+\\z", "")
    return F.when(slug == "", F.lit("untitled")).otherwise(slug)


def title_from_stem(stem: Column) -> Column:
    """Title case where every run of letters starts upper-case, with ``_`` and ``-`` read as spaces."""
    spaced = F.translate(stem, "_-", "  ")
    # a space after each non-letter lets initcap see every run of letters; the marker takes it out again
    marked = F.regexp_replace(F.lower(spaced), r"(?<=[^\p{L}])(?=\p{L})", "\uffff ")
    return F.replace(F.initcap(marked), F.lit("\uffff "), F.lit(""))


def normalize_surface(surface: Column) -> Column:
    """Comparable form of a name: outer punctuation and one leading article dropped, lower case.

    Most names are words of letters and digits between single spaces; of those only case and article remain to be seen to.
    """
    punct = "[" + "".join("\\" + c for c in vocab.OUTER_PUNCTUATION) + "]"
    bare = strip_ws(F.regexp_replace(strip_ws(surface), f"^{punct}+|{punct}+\\z", ""))
    named = lambda plain: F.regexp_replace(F.lower(plain), "^(?:the|a|an) ", "")
    return F.when(surface.rlike(r"\A[\p{L}\p{N}]+(?: [\p{L}\p{N}]+)*\z"), named(surface)).otherwise(F.trim(named(F.regexp_replace(bare, f"{WS}+", " "))))


def normalize_citation(s: Column) -> Column:
    """NFKC, case folding, punctuation to spaces, whitespace squeezed."""
    return squeeze(F.regexp_replace(nfkc_casefold(s), r"(?U)[^\w\s]+", " "))


# ------------------------------------------------------------------ cleaning


def unify_newlines(s: Column) -> Column:
    return F.regexp_replace(s, r"\r\n?", "\n")


def dehyphenate(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)(?<=\w)-\n(?=\w)", "")


def _is_cruft(line: Column, pattern: Column | str) -> Column:
    """A literal pattern compiles once; a per-work pattern comes as a column."""
    p = F.lit(f"(?i){pattern}") if isinstance(pattern, str) else F.concat(F.lit("(?i)"), pattern)
    return (strip_ws(line) != "") & F.rlike(line, p)


def cruft_lines(s: Column, pattern: Column | str | None) -> Column:
    """The lines a pattern removes, trimmed (an array)."""
    if pattern is None:
        return F.array().cast("array<string>")
    found = F.transform(F.filter(F.split(s, "\n"), lambda x: F.coalesce(_is_cruft(x, pattern), F.lit(False))), strip_ws)
    return found


def drop_cruft(s: Column, pattern: Column | str | None) -> Column:
    if pattern is None:
        return s
    return F.array_join(F.filter(F.split(s, "\n"), lambda x: ~F.coalesce(_is_cruft(x, pattern), F.lit(False))), "\n")


def any_of(patterns: list[str]) -> str | None:
    """One alternation for a list of removal patterns."""
    return "|".join(f"(?:{p})" for p in patterns) if patterns else None


def reflow(s: Column, newline_is_paragraph: Column) -> Column:
    """Paragraphs joined by one blank line, soft wraps inside a paragraph joined by a space."""
    blocks = F.when(newline_is_paragraph, F.split(s, "\n")).otherwise(F.split(F.regexp_replace(s, "\n{3,}", "\n\n"), "\n\n"))
    flat = F.transform(blocks, lambda p: strip_ws(F.regexp_replace(F.translate(p, "\n", " "), "[ \t]+", " ")))
    return F.array_join(F.filter(flat, lambda p: p != ""), "\n\n")


# ------------------------------------------------------------------ sentences and chunks


def with_sentence_spans(df: DataFrame, text: str, out: str = "spans") -> DataFrame:
    """Add ``array<struct<start,end>>``: sentence spans as code point offsets, leading whitespace excluded.

    The text is cut at zero-width positions, so nothing is lost and offsets follow
    from the lengths of the pieces.
    """
    cut_at = f"(?:(?<={TERMINATORS})|(?<={TERMINATORS}{CLOSERS}))(?={WS}|\\z)"
    pieces = df.withColumn("__p", F.filter(F.split(text, cut_at, -1), lambda p: p.rlike(f"[^{WS[1:-1]}]")))
    # only a last whitespace-only piece can be filtered out, so starts stay right
    starts = pieces.withColumn("__l", F.transform("__p", lambda p: F.length(p))).withColumn("__s", running_starts(F.col("__l")))
    lead = lambda p: F.length(p) - F.length(F.regexp_replace(p, f"^{WS}+", ""))
    return starts.withColumn(
        out,
        F.zip_with("__p", "__s", lambda p, s: F.struct((s + lead(p)).alias("start"), (s + F.length(p)).alias("end"))),
    ).drop("__p", "__l", "__s")


def with_chunk_spans(df: DataFrame, spans: str, max_chars: Column, overlap: Column, out: str = "chunk_spans") -> DataFrame:
    """Greedy sentence-aligned chunks over a spans column: one pass over the sentences of a text.

    A chunk takes sentences while it stays within ``max_chars``; a longer sentence stands
    alone. The next chunk starts ``overlap`` sentences back, but always later than this one.
    """
    sp = F.col(spans)
    start0 = F.struct(
        F.lit(1).alias("i"), F.lit(0).alias("first"), F.lit(0).alias("last"),
        F.array().cast("array<struct<first:int,last:int>>").alias("out"),
    )

    def step(st: Column, x: Column) -> Column:
        i = st["i"]
        fits = x["end"] - sp[st["first"]]["start"] <= max_chars
        lowest = F.greatest(st["first"] + 1, i - overlap)
        nxt = F.filter(F.sequence(lowest, i), lambda f: (f == i) | (x["end"] - sp[f]["start"] <= max_chars))[0]
        closed = F.concat(
            F.array(F.struct(st["first"].alias("first"), (i - 1).alias("last"))),
            F.transform(
                F.filter(F.sequence(lowest, i), lambda f: (f < nxt)),
                lambda f: F.struct(f.alias("first"), (i - 1).alias("last")),
            ),
        )
        return F.struct(
            (i + 1).alias("i"),
            F.when(fits, st["first"]).otherwise(nxt).alias("first"),
            i.alias("last"),
            F.when(fits, st["out"]).otherwise(F.concat(st["out"], closed)).alias("out"),
        )

    def finish(st: Column) -> Column:
        return F.concat(st["out"], F.array(F.struct(st["first"].alias("first"), st["last"].alias("last"))))

    ranges = F.when(F.size(sp) == 0, F.array().cast("array<struct<first:int,last:int>>")).otherwise(
        F.aggregate(F.slice(sp, 2, F.greatest(F.size(sp), F.lit(1))), start0, step, finish)
    )
    return df.withColumn("__r", ranges).withColumn(
        out,
        F.transform("__r", lambda r: F.struct(sp[r["first"]]["start"].alias("char_start"), sp[r["last"]]["end"].alias("char_end"))),
    ).drop("__r")


def snippet(text: Column, start: Column, end: Column, pad: int) -> Column:
    """``text[start-pad : end+pad]`` with whitespace squeezed; offsets are code points."""
    lo = F.greatest(start - pad, F.lit(0))
    return squeeze(F.substring(text, lo + 1, end + pad - lo))


_BLOCK = 1024


def blocks(text: Column) -> Column:
    """The text in blocks of 1,024 code points. A substring walks a text from its start, and counts all of it first; where many places of
    one text are asked for, only the blocks around each are touched (``block_slice``)."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def block_slice(blocks: Column, start: Column, end: Column) -> Column:
    """``text[start : end]`` of a text in blocks, however long."""
    first = F.floor(start / _BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.floor(end / _BLOCK).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), start - first * _BLOCK + 1, end - start)


def block_snippet(blocks: Column, start: Column, end: Column, pad: int) -> Column:
    """``snippet`` of a text in blocks."""
    return squeeze(block_slice(blocks, F.greatest(start - pad, F.lit(0)), end + pad))
