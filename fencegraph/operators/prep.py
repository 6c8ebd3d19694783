"""Corpus preparation: chapter detection, cleaning, chunking, idempotent upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencegraph.config import DEFAULTS
from fencegraph.functions import text as X

HEADING = str(DEFAULTS["heading_regex"])
DELIMITER = str(DEFAULTS["delimiter"])
_FLAGS = "(?imdU)"  # any case, per-line anchors, only \n ends a line, Unicode classes
_CHAPTERS = "array<struct<title:string,ordinal:int,raw_text:string>>"


def _int_in(s: Column) -> Column:
    digits = F.regexp_extract(s, r"\d+", 0)
    return F.when(digits != "", digits.try_cast("int"))


def by_heading(text: Column, heading: str, first: Column) -> Column:
    """Chapters between heading lines; ordinal = first integer of the heading; text before the first heading is dropped."""
    p = F.lit(_FLAGS + heading)
    titles = F.regexp_extract_all(text, p, F.lit(0))
    bodies = F.split(text, p, -1)
    both = F.arrays_zip(F.transform(titles, X.strip_ws).alias("t"), F.slice(bodies, 2, F.greatest(F.size(titles), F.lit(1))).alias("b"))
    found = F.transform(
        both, lambda z, i: F.struct(z["t"].alias("title"), F.coalesce(_int_in(z["t"]), i + first).alias("ordinal"), z["b"].alias("raw_text"))
    )
    return F.when(F.size(titles) > 0, found).otherwise(whole_file(text, first))


def by_delimiter(text: Column, delimiter: str, first: Column) -> Column:
    """Parts between delimiters; blank parts go before numbering."""
    parts = F.filter(F.split(text, "\\Q" + delimiter + "\\E", -1), lambda p: X.strip_ws(p) != "")
    return F.transform(parts, lambda p, i: F.struct(F.lit(None).cast("string").alias("title"), (i + first).alias("ordinal"), p.alias("raw_text")))


def whole_file(text: Column, first: Column) -> Column:
    return F.array(F.struct(F.lit(None).cast("string").alias("title"), first.alias("ordinal"), text.alias("raw_text")))


def detect(sources: DataFrame, *, mode: str = "auto", heading: str = HEADING, delimiter: str = DELIMITER, first: int | Column = 1) -> DataFrame:
    """Chapters of single-file sources (work_id, raw_text): (work_id, src_pos, ordinal, title, raw_text).

    ``auto`` takes headings if any line is one, else the delimiter if it occurs, else the whole file.
    """
    t, n = F.col("raw_text"), first if isinstance(first, Column) else F.lit(first)
    h, d, w = by_heading(t, heading, n).cast(_CHAPTERS), by_delimiter(t, delimiter, n).cast(_CHAPTERS), whole_file(t, n).cast(_CHAPTERS)
    pick = {"heading": h, "delimiter": d, "file": w}.get(mode)
    if pick is None:
        if mode != "auto":
            raise ValueError(f"unknown chapter mode {mode!r}")
        pick = F.when(t.rlike(_FLAGS + heading), h).when(F.contains(t, F.lit(delimiter)), d).otherwise(w)
    keep = [c for c in sources.columns if c not in ("raw_text", "title", "ordinal")]
    return sources.select(*keep, F.posexplode(pick).alias("src_pos", "c")).select(*keep, "src_pos", "c.ordinal", "c.title", "c.raw_text")


def leading_heading(df: DataFrame, text: str, fallback: Column, heading: str = HEADING) -> DataFrame:
    """Add title and body: the first non-blank line is the title if it is a heading, else ``fallback`` is."""
    blank = rf"(?:[{X.WS[1:-1]}&&[^\n]]*\n)*"
    line = F.regexp_extract(text, rf"\A{blank}([^\n]*)", 1)
    rest = F.regexp_replace(text, rf"\A{blank}[^\n]*\n?", "")
    is_title = (X.strip_ws(line) != "") & line.rlike(rf"(?idU)\A(?:{heading})")
    return df.withColumn("title", F.when(is_title, X.strip_ws(line)).otherwise(fallback)).withColumn(
        "body", F.when(is_title, rest).otherwise(F.col(text))
    )


def clean(df: DataFrame, *, cruft: list[str] | Column | None = None, dehyphenate: bool = True, newline_is_paragraph: bool | Column = False) -> DataFrame:
    """Add clean_text and removed_lines. Only NFKC leaves the JVM, one narrow column through Arrow."""
    pattern = X.any_of(cruft) if isinstance(cruft, list) else cruft
    flag = newline_is_paragraph if isinstance(newline_is_paragraph, Column) else F.lit(newline_is_paragraph)
    t = df.withColumn("__t", X.unify_newlines(X.nfkc(F.col("raw_text"))))
    if dehyphenate:
        t = t.withColumn("__t", X.dehyphenate(F.col("__t")))
    t = t.withColumn("removed_lines", X.cruft_lines(F.col("__t"), pattern))
    return t.withColumn("clean_text", X.reflow(X.drop_cruft(F.col("__t"), pattern), flag)).drop("__t")


def first_per_ordinal(chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, duplicates): the first chapter in source order claims its ordinal.

    The claim is a narrow aggregation; the text is only touched by a join on a unique key.
    """
    claim = chapters.groupBy("work_id", "ordinal").agg(F.min("src_pos").alias("src_pos"))
    key = ["work_id", "ordinal", "src_pos"]
    return chapters.join(claim, key, "left_semi"), chapters.join(claim, key, "left_anti")


def drop_empty(chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, empty after cleaning). Run after ``first_per_ordinal``: an empty chapter still claims its ordinal."""
    return chapters.filter("clean_text <> ''"), chapters.filter("clean_text = ''")


def as_chapters(cleaned: DataFrame, source_path: Column | None = None) -> DataFrame:
    path = source_path if source_path is not None else F.lit(None).cast("string")
    return cleaned.select("work_id", "ordinal", "title", "clean_text", X.sha256(F.col("clean_text")).alias("content_hash"), path.alias("source_path"))


def chunk_chapters(chapters: DataFrame, max_chars: int | Column = 1500, overlap: int | Column = 1) -> DataFrame:
    """Sentence-aligned chunks. Texts are slices of their chapter, so the offset invariant holds by construction."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    c = X.with_chunk_spans(X.with_sentence_spans(chapters, "clean_text"), "spans", lit(max_chars), lit(overlap))
    sliced = F.transform(
        "chunk_spans",
        lambda s: F.struct(
            s["char_start"].alias("char_start"), s["char_end"].alias("char_end"),
            F.substring(F.col("clean_text"), s["char_start"] + 1, s["char_end"] - s["char_start"]).alias("text"),
        ),
    )
    x = c.select("work_id", F.col("ordinal").alias("chapter_ordinal"), F.posexplode(sliced).alias("ordinal", "c"))
    return x.select("work_id", "chapter_ordinal", "ordinal", "c.char_start", "c.char_end", "c.text", X.sha256(F.col("c.text")).alias("content_hash"))


# ------------------------------------------------------------------ outline, upsert, report


def outline(detected: DataFrame, stored: DataFrame) -> DataFrame:
    """Preview of detected chapters against stored ones; nothing is written."""
    have = stored.select("work_id", "ordinal", F.lit(True).alias("__have"))
    return detected.select("work_id", "ordinal", "title").join(have, ["work_id", "ordinal"], "left").select(
        "work_id", "ordinal", "title", F.col("__have").isNull().alias("is_new")
    )


def diff_chapters(arriving: DataFrame, stored: DataFrame) -> DataFrame:
    """(work_id, ordinal, action): added, updated, unchanged, or kept (stored, not in the source)."""
    a = arriving.select("work_id", "ordinal", F.col("content_hash").alias("new_hash"))
    s = stored.select("work_id", "ordinal", F.col("content_hash").alias("old_hash"))
    j = a.join(s, ["work_id", "ordinal"], "full_outer")
    action = (
        F.when(F.col("new_hash").isNull(), "kept").when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash") == F.col("old_hash"), "unchanged").otherwise("updated")
    )
    return j.select("work_id", "ordinal", action.alias("action"))


def upsert_chapters(arriving: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored chapters after an ingest: new and changed ones replaced, everything else as it was."""
    changed = diff_chapters(arriving, stored).filter("action IN ('added', 'updated')").select("work_id", "ordinal")
    return stored.join(changed, ["work_id", "ordinal"], "left_anti").unionByName(arriving.join(changed, ["work_id", "ordinal"], "left_semi"))


def changed_works(diff: DataFrame) -> DataFrame:
    """Works whose derived tables must be rebuilt."""
    return diff.filter("action IN ('added', 'updated')").select("work_id").distinct()


def ingest_report(diff: DataFrame, chunks: DataFrame, cleaned: DataFrame, duplicates: DataFrame, empties: DataFrame) -> DataFrame:
    """Counts per work: added, updated, unchanged, chunks of written chapters, removed lines, warnings."""
    written = diff.filter("action IN ('added', 'updated')")
    c = chunks.join(written.select("work_id", F.col("ordinal").alias("chapter_ordinal")), ["work_id", "chapter_ordinal"], "left_semi")
    count = lambda df, name: df.groupBy("work_id").agg(F.count(F.lit(1)).alias(name))
    out = diff.groupBy("work_id").agg(*[F.count_if(F.col("action") == a).alias(f"chapters_{a}") for a in ("added", "updated", "unchanged")])
    lines = cleaned.groupBy("work_id").agg(F.sum(F.size("removed_lines")).alias("cruft_lines_removed"))
    for part in (count(c, "chunks_added"), lines, count(duplicates, "duplicate_warnings"), count(empties, "empty_warnings")):
        out = out.join(part, "work_id", "left")
    return out.na.fill(0)
