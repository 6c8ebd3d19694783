"""Corpus preparation over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fencegraph.catalog.base import DOCS, query
from fencegraph.catalog.entity_queries import chapters
from fencegraph.catalog.registry import Registry
from fencegraph.functions import text as X
from fencegraph.functions.lineage import cut
from fencegraph.operators import prep as P
from fencegraph.sources import adaptors as A

R = Registry()
ORIGINAL = "SELECT doc_id, md5(text) AS text_hash FROM documents"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return A.spread(A.table(spark, d, "documents").select("doc_id", "text"))


def hashed(df: DataFrame, text: str) -> DataFrame:
    return df.select("doc_id", F.md5(F.col(text).cast("binary")).alias("text_hash"))


@R.add("b1_nfkc", ORIGINAL)
def nfkc(spark: SparkSession, d: str) -> DataFrame:
    """Upper-case letters made full-width; normalising restores the text."""
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    wide = F.translate("text", up, "".join(chr(ord(c) + 0xFEE0) for c in up))
    return hashed(docs(spark, d).select("doc_id", X.nfkc(wide).alias("t")), "t")


@R.add("b2_newlines", ORIGINAL)
def newlines(spark: SparkSession, d: str) -> DataFrame:
    crlf = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.translate("text", "\n", "\r"))
    return hashed(docs(spark, d).select("doc_id", X.unify_newlines(crlf).alias("t")), "t")


@R.add("b3_dehyphenation", ORIGINAL)
def dehyphenation(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.replace("text", F.lit(" th"), F.lit(" t-\nh"))
    return hashed(docs(spark, d).select("doc_id", X.dehyphenate(wrapped).alias("t")), "t")


CRUFT = ["^than\\b", "eaux\\.$", "\\|"]
_rx = "'(?i)(?:^than\\b)|(?:eaux\\.$)|(?:\\|)'"
LINES = "ln AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)"


@R.add("b4_removed_lines", query([LINES], f"SELECT doc_id, trim(line) AS line, count(*) AS times FROM ln WHERE regexp_matches(line, {_rx}) GROUP BY ALL"))
def removed_lines(spark: SparkSession, d: str) -> DataFrame:
    gone = docs(spark, d).select("doc_id", F.explode(X.cruft_lines(F.col("text"), X.any_of(CRUFT))).alias("line"))
    return gone.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("times"))


@R.add("b4_kept_text", query([LINES], f"SELECT d.doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY i), '')) AS text_hash FROM documents d LEFT JOIN ln ON ln.doc_id = d.doc_id AND NOT regexp_matches(line, {_rx}) GROUP BY d.doc_id"))
def kept_text(spark: SparkSession, d: str) -> DataFrame:
    return hashed(docs(spark, d).select("doc_id", X.drop_cruft(F.col("text"), X.any_of(CRUFT)).alias("t")), "t")


@R.add("b5_reflow_soft_wraps", "SELECT doc_id, md5(trim(regexp_replace(replace(text, chr(10), ' '), '[ \\t]+', ' ', 'g'))) AS text_hash FROM documents")
def reflow_soft(spark: SparkSession, d: str) -> DataFrame:
    return hashed(docs(spark, d).select("doc_id", X.reflow(F.col("text"), F.lit(False)).alias("t")), "t")


@R.add("b5_reflow_lines", query([LINES], "SELECT doc_id, md5(string_agg(trim(regexp_replace(line, '[ \\t]+', ' ', 'g')), chr(10) || chr(10) ORDER BY i)) AS text_hash FROM ln WHERE trim(line) <> '' GROUP BY doc_id"))
def reflow_lines(spark: SparkSession, d: str) -> DataFrame:
    return hashed(docs(spark, d).select("doc_id", X.reflow(F.col("text"), F.lit(True)).alias("t")), "t")


@R.add(
    "b6_slugs_and_titles",
    """SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ' #' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled') AS slug,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS title FROM part""",
)
def slugs(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    return p.select(
        "p_partkey", X.slugify(F.concat("p_name", F.lit(" #"), "p_brand")).alias("slug"), X.title_from_stem(F.translate("p_name", " ", "_")).alias("title")
    )


@R.add("b7_content_hashes", query([DOCS], "SELECT work_id, ordinal, sha256(clean_text) AS content_hash FROM ch"))
def hashes(spark: SparkSession, d: str) -> DataFrame:
    return chapters(spark, d).select("work_id", "ordinal", X.sha256(F.col("clean_text")).alias("content_hash"))


BOOK = "SELECT doc_id + 1 AS work_id, CAST(i AS INTEGER) AS ordinal, 'Chapter ' || i || ': part' AS title"


@R.add("b8_heading_chapters", query([LINES], f"{BOOK} FROM ln"))
def heading_chapters(spark: SparkSession, d: str) -> DataFrame:
    return P.detect(A.book_sources(spark, d), mode="heading").select("work_id", "ordinal", "title")


@R.add("b8_cleaned_book", query([LINES], "SELECT doc_id + 1 AS work_id, CAST(i AS INTEGER) AS ordinal, md5(trim(regexp_replace(line, '[ \\t]+', ' ', 'g'))) AS text_hash, ['[T/N: a note]'] AS removed_lines FROM ln"))
def cleaned_book(spark: SparkSession, d: str) -> DataFrame:
    """Split by headings, then cleaned: every line of the document is restored and every note reported."""
    c = P.clean(P.detect(A.book_sources(spark, d), mode="heading"), cruft=["^\\[T/N:"])
    return c.select("work_id", "ordinal", F.md5(F.col("clean_text").cast("binary")).alias("text_hash"), "removed_lines")


def delimited(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("  \n---\n"), F.replace("text", F.lit("\n"), F.lit("\n---\n")), F.lit("\n---\n \n---\n"))
    return docs(spark, d).select((F.col("doc_id") + 1).alias("work_id"), raw.alias("raw_text"))


@R.add("b9_delimited_chapters", query([LINES], "SELECT doc_id + 1 AS work_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS ordinal, md5(line) AS text_hash FROM ln WHERE trim(line) <> ''"))
def delimited_chapters(spark: SparkSession, d: str) -> DataFrame:
    return P.detect(delimited(spark, d), mode="delimiter").select("work_id", "ordinal", F.md5(F.col("raw_text").cast("binary")).alias("text_hash"))


@R.add("b10_whole_files", "SELECT doc_id + 1 AS work_id, 7 AS ordinal, md5(text) AS text_hash FROM documents")
def whole_files(spark: SparkSession, d: str) -> DataFrame:
    src = docs(spark, d).select((F.col("doc_id") + 1).alias("work_id"), F.col("text").alias("raw_text"))
    return P.detect(src, mode="file", first=7).select("work_id", "ordinal", F.md5(F.col("raw_text").cast("binary")).alias("text_hash"))


@R.add(
    "b11_auto_chapters",
    query(
        [LINES],
        """, k AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (trim(line) <> '') AS parts FROM ln GROUP BY ALL)
        SELECT doc_id + 1 AS work_id, CASE (doc_id + 1) % 3 WHEN 0 THEN lines WHEN 1 THEN parts ELSE 1 END AS chapters, doc_id % 3 = 2 AS titled FROM k""",
    ),
)
def auto_chapters(spark: SparkSession, d: str) -> DataFrame:
    """A third of the sources has headings, a third delimiters, a third neither."""
    plain = docs(spark, d).select((F.col("doc_id") + 1).alias("work_id"), F.col("text").alias("plain"))
    src = plain.join(A.book_sources(spark, d).select("work_id", F.col("raw_text").alias("book")), "work_id").join(
        delimited(spark, d).select("work_id", F.col("raw_text").alias("parts")), "work_id"
    )
    raw = F.when(F.col("work_id") % 3 == 0, F.col("book")).when(F.col("work_id") % 3 == 1, F.col("parts")).otherwise(F.col("plain"))
    return P.detect(src.select("work_id", raw.alias("raw_text"))).groupBy("work_id").agg(
        F.count(F.lit(1)).alias("chapters"), F.bool_or(F.col("title").isNotNull()).alias("titled")
    )


@R.add(
    "b12_leading_headings",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'CHAPTER 5: The ' || doc_id ELSE 'ch' || doc_id END AS title, md5(text) AS text_hash FROM documents",
)
def leading_headings(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.lit(" \n\nCHAPTER 5: The "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))
    src = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 1, head).otherwise(F.col("text")).alias("raw"))
    got = P.leading_heading(src, "raw", F.concat(F.lit("ch"), F.col("doc_id").cast("string")))
    return got.select("doc_id", "title", F.md5(F.col("body").cast("binary")).alias("text_hash"))


def colliding(spark: SparkSession, d: str) -> DataFrame:
    """Chapters whose ordinals collide: three in a row share one."""
    return chapters(spark, d).select("work_id", F.col("ordinal").alias("src_pos"), F.floor(F.col("ordinal") / 3).cast("int").alias("ordinal"), "title", F.col("clean_text").alias("raw_text"))


COLLIDING = "\nco AS (SELECT work_id, ordinal AS src_pos, ordinal // 3 AS ordinal, row_number() OVER (PARTITION BY work_id, ordinal // 3 ORDER BY ordinal) AS rk FROM ch)"


@R.add("b13_first_per_ordinal", query([DOCS, COLLIDING], "SELECT work_id, CAST(ordinal AS INTEGER) AS ordinal, src_pos, rk > 1 AS duplicate FROM co"))
def unique_ordinals(spark: SparkSession, d: str) -> DataFrame:
    kept, dup = P.first_per_ordinal(colliding(spark, d))
    cols = ["work_id", "ordinal", "src_pos"]
    return kept.select(*cols, F.lit(False).alias("duplicate")).unionByName(dup.select(*cols, F.lit(True).alias("duplicate")))


@R.add("b14_empty_chapters", query([DOCS], "SELECT work_id, count(*) FILTER (ordinal % 7 <> 0) AS kept, count(*) FILTER (ordinal % 7 = 0) AS empty FROM ch GROUP BY ALL"))
def empty_chapters(spark: SparkSession, d: str) -> DataFrame:
    raw = chapters(spark, d).select("work_id", "ordinal", F.when(F.col("ordinal") % 7 == 0, "  \n[T/N: only a note]\n ").otherwise(F.col("clean_text")).alias("raw_text"))
    kept, empty = P.drop_empty(cut(P.clean(raw, cruft=["^\\[T/N:"]).select("work_id", "clean_text")))
    both = kept.select("work_id", F.lit(1).alias("k"), F.lit(0).alias("e")).unionByName(empty.select("work_id", F.lit(0).alias("k"), F.lit(1).alias("e")))
    return both.groupBy("work_id").agg(F.sum("k").alias("kept"), F.sum("e").alias("empty"))


_ws = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SENT = rf"""
mk AS (SELECT work_id, ordinal, clean_text, string_split(regexp_replace(clean_text, '([.!?。！？]["''”’)\]]?)({_ws}|$)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM ch),
pc AS (SELECT work_id, ordinal, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM mk),
po AS (SELECT *, CAST(sum(length(p)) OVER (PARTITION BY work_id, ordinal ORDER BY i) AS INTEGER) AS e FROM pc),
sn AS (SELECT work_id, ordinal, CAST(row_number() OVER (PARTITION BY work_id, ordinal ORDER BY i) - 1 AS INTEGER) AS i,
              CAST(e - length(regexp_replace(p, '^{_ws}+', '')) AS INTEGER) AS s, e FROM po WHERE regexp_replace(p, '^{_ws}+', '') <> '')"""


def chunk_sql(max_chars: int, overlap: int) -> str:
    nxt = f"greatest(w.i + 1, l.last + 1 - {overlap})" if overlap else "l.last + 1"
    return f"""
ls AS (SELECT a.work_id, a.ordinal, a.i, a.s, greatest(a.i, coalesce(max(b.i), a.i)) AS last, any_value(n.n) AS n
       FROM sn a LEFT JOIN sn b ON b.work_id = a.work_id AND b.ordinal = a.ordinal AND b.i > a.i AND b.e <= a.s + {max_chars}
       JOIN (SELECT work_id, ordinal, count(*) AS n FROM sn GROUP BY ALL) n ON n.work_id = a.work_id AND n.ordinal = a.ordinal GROUP BY a.work_id, a.ordinal, a.i, a.s),
wk AS (SELECT work_id, ordinal, 0 AS i FROM sn WHERE i = 0 UNION ALL
       SELECT w.work_id, w.ordinal, {nxt} FROM wk w JOIN ls l ON l.work_id = w.work_id AND l.ordinal = w.ordinal AND l.i = w.i WHERE l.last + 1 < l.n),
ck AS (SELECT w.work_id, w.ordinal AS chapter_ordinal, CAST(row_number() OVER (PARTITION BY w.work_id, w.ordinal ORDER BY w.i) - 1 AS INTEGER) AS ordinal,
              l.s AS char_start, z.e AS char_end, c.clean_text
       FROM wk w JOIN ls l ON l.work_id = w.work_id AND l.ordinal = w.ordinal AND l.i = w.i JOIN sn z ON z.work_id = w.work_id AND z.ordinal = w.ordinal AND z.i = l.last
       JOIN ch c ON c.work_id = w.work_id AND c.ordinal = w.ordinal)"""


@R.add("b15_sentence_spans", query([DOCS, SENT], "SELECT work_id, ordinal, s AS start, e AS \"end\" FROM sn"))
def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    return X.with_sentence_spans(chapters(spark, d), "clean_text").select("work_id", "ordinal", F.explode("spans").alias("s")).select("work_id", "ordinal", "s.start", "s.end")


@R.add("b16_chunk_spans", query([DOCS, SENT, chunk_sql(600, 2)], "SELECT work_id, chapter_ordinal, ordinal, char_start, char_end FROM ck", recursive=True))
def chunk_spans(spark: SparkSession, d: str) -> DataFrame:
    return P.chunk_chapters(chapters(spark, d), 600, 2).select("work_id", "chapter_ordinal", "ordinal", "char_start", "char_end")


CHUNKS = [DOCS, SENT, chunk_sql(1500, 1)]


@R.add("b17_chunks", query(CHUNKS, "SELECT work_id, chapter_ordinal, ordinal, char_start, char_end, sha256(substr(clean_text, char_start + 1, char_end - char_start)) AS content_hash FROM ck", recursive=True))
def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    return P.chunk_chapters(chapters(spark, d)).drop("text")


def stored_chapters(spark: SparkSession, d: str) -> DataFrame:
    """What is already stored: odd chapters, of which every fifth has other text."""
    c = chapters(spark, d).filter("ordinal % 2 = 1")
    old = F.when(F.col("ordinal") % 5 == 0, F.concat(F.lit("old "), F.col("clean_text"))).otherwise(F.col("clean_text"))
    c = c.withColumn("clean_text", old).withColumn("content_hash", X.sha256(F.col("clean_text")))
    return c.unionByName(c.filter("ordinal = 1").withColumn("ordinal", F.lit(-1)))  # one chapter the source does not have


ACTIONS = """
dv AS (SELECT work_id, ordinal, CASE WHEN ordinal % 2 = 0 THEN 'added' WHEN ordinal % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM ch
       UNION ALL SELECT work_id, -1, 'kept' FROM ch WHERE ordinal = 1)"""


@R.add("b18_outline_preview", query([DOCS], "SELECT work_id, ordinal, title, ordinal % 2 = 0 AS is_new FROM (SELECT work_id, ordinal, CAST(NULL AS VARCHAR) AS title FROM ch)"))
def outline_preview(spark: SparkSession, d: str) -> DataFrame:
    return P.outline(chapters(spark, d), stored_chapters(spark, d))


@R.add("b19_upsert_actions", query([DOCS, ACTIONS], "SELECT work_id, ordinal, action FROM dv"))
def upsert_actions(spark: SparkSession, d: str) -> DataFrame:
    return P.diff_chapters(chapters(spark, d), stored_chapters(spark, d))


@R.add("b19_upserted_chapters", query([DOCS], "SELECT work_id, ordinal, sha256(clean_text) AS content_hash FROM ch UNION ALL SELECT work_id, -1, sha256(clean_text) FROM ch WHERE ordinal = 1"))
def upserted(spark: SparkSession, d: str) -> DataFrame:
    return P.upsert_chapters(chapters(spark, d), stored_chapters(spark, d)).select("work_id", "ordinal", "content_hash")


@R.add(
    "b20_appended_chunks",
    query(CHUNKS, "SELECT work_id, count(*) AS chunks FROM ck WHERE chapter_ordinal % 2 = 0 OR chapter_ordinal % 5 = 0 GROUP BY ALL", recursive=True),
)
def appended(spark: SparkSession, d: str) -> DataFrame:
    """Only chapters the diff added or changed are chunked again."""
    diff = P.diff_chapters(chapters(spark, d), stored_chapters(spark, d)).filter("action IN ('added', 'updated')")
    todo = chapters(spark, d).join(diff.select("work_id", "ordinal"), ["work_id", "ordinal"], "left_semi")
    return P.chunk_chapters(todo).groupBy("work_id").agg(F.count(F.lit(1)).alias("chunks"))


@R.add(
    "b21_ingest_report",
    query(
        [*CHUNKS, ACTIONS],
        f""", c AS (SELECT k.work_id, count(*) AS n FROM ck k JOIN dv ON dv.work_id = k.work_id AND dv.ordinal = k.chapter_ordinal AND action IN ('added', 'updated') GROUP BY ALL),
        x AS (SELECT work_id, count(*) AS n FROM (SELECT work_id, unnest(string_split(clean_text, chr(10))) AS line FROM ch) WHERE regexp_matches(line, {_rx}) GROUP BY ALL)
        SELECT dv.work_id, count(*) FILTER (action = 'added') AS chapters_added, count(*) FILTER (action = 'updated') AS chapters_updated, count(*) FILTER (action = 'unchanged') AS chapters_unchanged,
        coalesce(any_value(c.n), 0) AS chunks_added, coalesce(any_value(x.n), 0) AS cruft_lines_removed FROM dv LEFT JOIN c ON c.work_id = dv.work_id LEFT JOIN x ON x.work_id = dv.work_id GROUP BY dv.work_id""",
        recursive=True,
    ),
)
def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    src = chapters(spark, d)
    cleaned = src.select("work_id", X.cruft_lines(F.col("clean_text"), X.any_of(CRUFT)).alias("removed_lines"))
    diff = cut(P.diff_chapters(src, stored_chapters(spark, d)), "diff")
    none = src.filter("false")
    r = P.ingest_report(diff, P.chunk_chapters(src), cleaned, none, none)
    return r.drop("duplicate_warnings", "empty_warnings")


@R.add("h12_offset_invariant", query(CHUNKS, "SELECT count(*) AS chunks, CAST(0 AS BIGINT) AS violations FROM ck", recursive=True))
def offset_invariant(spark: SparkSession, d: str) -> DataFrame:
    from fencegraph.operators import quality

    c = cut(P.chunk_chapters(chapters(spark, d)), "chunks")
    bad = quality.offset_violations(c, chapters(spark, d)).agg(F.count(F.lit(1))).scalar()
    return c.agg(F.count(F.lit(1)).alias("chunks")).select("chunks", bad.alias("violations"))


QUERIES, ORACLES = R.queries, R.oracles
