"""Fenced search over ``embeddings`` and over chunks of ``documents``; queries come from the tables too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fencegraph import vocab
from fencegraph.catalog.base import DOCS, SPANS, TOKENS, VECTORS, hex_int, norm, query, quoted, sql_list
from fencegraph.catalog.entity_queries import chapters
from fencegraph.catalog.prep_queries import CHUNKS
from fencegraph.catalog.registry import Registry
from fencegraph.functions import text as X
from fencegraph.functions.lineage import scratch, stored
from fencegraph.operators import entities as E
from fencegraph.operators import fence
from fencegraph.operators import prep as P
from fencegraph.operators import search as S
from fencegraph.plans import build
from fencegraph.sources import adaptors as A
from fencegraph.sources.store import GraphStore
from fencegraph.sources.vector_index import VectorIndex

R = Registry()
COS = "CASE WHEN list_dot_product({a}, {a}) > 0 AND list_dot_product({b}, {b}) > 0 THEN list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) ELSE 0 END"


def vector_queries(v: DataFrame) -> DataFrame:
    """Every stored vector asks for its like, read from its own chapter."""
    return v.select(F.col("chunk_id").alias("q_id"), "work_id", F.col("chapter_ordinal").alias("n"), "embedding")


RANKED = f"""
sc AS (SELECT q.chunk_id AS q_id, q.work_id, c.chunk_id, round({COS.format(a="q.embedding", b="c.embedding")}, 9) AS score
       FROM vec q JOIN vec c ON c.work_id = q.work_id AND c.chapter_ordinal <= q.chapter_ordinal),
tp AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 5)"""


@R.add("e4_visible_chunks", query([VECTORS], "SELECT work_id, count(*) AS chunks, max(chapter_ordinal) AS deepest FROM vec WHERE chapter_ordinal <= 12 GROUP BY ALL"))
def visible_chunks(spark: SparkSession, d: str) -> DataFrame:
    v = fence.visible_chunks(A.vector_chunks(spark, d), 12)
    return v.groupBy("work_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("chapter_ordinal").alias("deepest"))


@R.add("f3_unit_vectors", query([VECTORS], "SELECT chunk_id, round(sqrt(list_dot_product(embedding, embedding)), 6) AS before, CAST(1.0 AS DOUBLE) AS after FROM vec"))
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = A.vector_chunks(spark, d).select("chunk_id", "embedding", S.l2_normalize(F.col("embedding")).alias("unit"))
    return v.select("chunk_id", F.round(S.norm2(F.col("embedding")), 6).alias("before"), F.round(S.norm2(F.col("unit")), 6).alias("after"))


@R.add("f4_neighbour_cosines", query([VECTORS], f", p AS (SELECT a.chunk_id, b.chunk_id AS other_id, a.embedding AS x, b.embedding AS y FROM vec a JOIN vec b ON b.chunk_id = a.chunk_id + 1) SELECT chunk_id, other_id, round({COS.format(a='x', b='y')}, 6) AS cosine FROM p"))
def neighbour_cosines(spark: SparkSession, d: str) -> DataFrame:
    v = A.vector_chunks(spark, d)
    nxt = v.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("chunk_id").alias("other_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "chunk_id").select("chunk_id", "other_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@R.add("f5_exact_top_k", query([VECTORS, RANKED], "SELECT q_id, work_id, chunk_id, round(score, 6) AS score, rank FROM tp"))
def exact_top_k(spark: SparkSession, d: str) -> DataFrame:
    v = A.vector_chunks(spark, d)
    return S.top_k(vector_queries(v), v, 5).withColumn("score", F.round("score", 6))


_BITS = 3
_cell = " + ".join(f"CASE WHEN list_dot_product(embedding, {p}::DOUBLE[]) > 0 THEN {1 << b} ELSE 0 END" for b, p in enumerate(S.planes(_BITS)))
APPROX = f"""
vc AS (SELECT *, {_cell} AS cell FROM vec),
sc AS (SELECT q.chunk_id AS q_id, q.work_id, c.chunk_id, round({COS.format(a="q.embedding", b="c.embedding")}, 9) AS score
       FROM vc q JOIN vc c ON c.work_id = q.work_id AND c.chapter_ordinal <= q.chapter_ordinal AND xor(q.cell, c.cell) IN (0, {", ".join(str(1 << b) for b in range(_BITS))})),
tp AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 5)"""


@R.add("f6_approximate_top_k", query([VECTORS, APPROX], "SELECT q_id, work_id, chunk_id, round(score, 6) AS score, rank FROM tp"))
def approx_top_k(spark: SparkSession, d: str) -> DataFrame:
    v = A.vector_chunks(spark, d)
    return S.approx_top_k(vector_queries(v), v, 5, bits=_BITS).withColumn("score", F.round("score", 6))


@R.add(
    "f7_upserted_index",
    query([VECTORS], "SELECT work_id, count(*) AS chunks, count(*) FILTER (chunk_id % 3 = 0) AS fresh FROM vec GROUP BY ALL"),
)
def upserted_index(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds are stored and a third arrives, half of it for the second time."""
    v = A.vector_chunks(spark, d)
    arriving = v.filter("chunk_id % 3 = 0").withColumn("text", F.lit("fresh"))
    index = S.upsert_chunks(v.filter("chunk_id % 3 <> 0 OR chunk_id % 2 = 0"), arriving)
    return index.groupBy("work_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("text") == "fresh").alias("fresh"))


@R.add("f7_replaced_works", query([VECTORS], "SELECT work_id, count(*) FILTER (work_id % 2 = 1 OR chapter_ordinal <= 10) AS chunks FROM vec GROUP BY ALL"))
def replaced_works(spark: SparkSession, d: str) -> DataFrame:
    """Even works are rebuilt with their first ten chapters only."""
    v = A.vector_chunks(spark, d)
    return S.replace_works(v, v.filter("work_id % 2 = 0 AND chapter_ordinal <= 10")).groupBy("work_id").agg(F.count(F.lit(1)).alias("chunks"))


# ------------------------------------------------------------------ stored index


def stored_index(spark: SparkSession, d: str) -> VectorIndex:
    index = VectorIndex(GraphStore(spark, scratch(spark, "index"), 8))
    index.build(as_chunks(A.vector_chunks(spark, d)))
    return index


def as_chunks(v: DataFrame) -> DataFrame:
    return v.select("work_id", "chunk_id", "chapter_ordinal", F.lit(0).alias("char_start"), F.lit(0).alias("char_end"), F.lit("stored").alias("text"), F.col("embedding").cast("array<double>").alias("embedding"))


@R.add(
    "f7_changed_index",
    query([VECTORS], """SELECT work_id, count(*) AS chunks, count(*) FILTER (chunk_id % 7 = 0) AS fresh, CAST(sum(chunk_id) AS BIGINT) AS id_sum FROM vec
    WHERE work_id % 4 <> 0 AND chapter_ordinal % 5 <> 0 AND (work_id % 4 <> 1 OR chapter_ordinal <= 10 OR chunk_id % 7 = 0) GROUP BY ALL"""),
)
def changed_index(spark: SparkSession, d: str) -> DataFrame:
    """A stored index after works were replaced by their first chapters, chunks upserted, works and chapters deleted."""
    v = as_chunks(A.vector_chunks(spark, d))
    index = stored_index(spark, d)
    some = v.filter("work_id % 4 = 1")
    index.replace_works(some.filter("chapter_ordinal <= 10"), some.select("work_id").distinct())
    index.upsert(v.filter("chunk_id % 7 = 0").withColumn("text", F.lit("fresh")))
    index.store.delete_works(v.filter("work_id % 4 = 0").select("work_id"))
    index.store.delete_chapters(v.filter("chapter_ordinal % 5 = 0").select("work_id", F.col("chapter_ordinal").alias("ordinal")))
    rows = index.store.rows("vectors")
    return rows.groupBy("work_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("text") == "fresh").alias("fresh"), F.sum("chunk_id").alias("id_sum"))


@R.add("f6_index_recall", query([VECTORS, RANKED], "SELECT q.work_id, count(DISTINCT q.chunk_id) AS queries, count(t.chunk_id) AS sought, true AS recall_reached FROM vec q LEFT JOIN tp t ON t.q_id = q.chunk_id GROUP BY ALL"))
def index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the stored index against exact ones, work by work: nine tenths of them are found."""
    v = as_chunks(A.vector_chunks(spark, d))
    asked = vector_queries(v)
    exact = S.top_k(asked, v, 5).select("work_id", "q_id", "chunk_id")
    met = stored_index(spark, d).top_k(asked, 5).select("work_id", "q_id", "chunk_id", F.lit(1).alias("met"))
    per = exact.join(met, ["work_id", "q_id", "chunk_id"], "left").groupBy("work_id").agg(F.count(F.lit(1)).alias("sought"), F.count("met").alias("found"))
    every = asked.groupBy("work_id").agg(F.count(F.lit(1)).alias("queries"))
    return every.join(per, "work_id").select("work_id", "queries", "sought", (F.col("found") >= 0.9 * F.col("sought")).alias("recall_reached"))


# ------------------------------------------------------------------ text chunks

SLOTS = """
cw AS (SELECT work_id, chapter_ordinal, ordinal, unnest(regexp_split_to_array(lower(substr(clean_text, char_start + 1, char_end - char_start)), '[ \\t\\n\\r]+')) AS w FROM ck),
sl AS (SELECT work_id, chapter_ordinal, ordinal, CAST(('0x' || right(md5(w), 2)) AS BIGINT) % 64 AS slot, CAST(count(*) AS BIGINT) AS n FROM cw WHERE w <> '' GROUP BY ALL)"""


def text_index(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, ("doc_index", d), lambda: S.index_chunks(A.spread(P.chunk_chapters(chapters(spark, d)))))


@R.add("f1_index_sizes", query(CHUNKS, "SELECT work_id, count(*) AS chunks, max(chapter_ordinal) AS last_chapter FROM ck GROUP BY ALL", recursive=True))
def index_sizes(spark: SparkSession, d: str) -> DataFrame:
    return text_index(spark, d).groupBy("work_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("chapter_ordinal").alias("last_chapter"))


@R.add("f2_hashed_words", query([*CHUNKS, SLOTS], "SELECT work_id, CAST(chapter_ordinal AS BIGINT) * 2147483648 + ordinal AS chunk_id, slot, n FROM sl", recursive=True))
def hashed_words(spark: SparkSession, d: str) -> DataFrame:
    x = text_index(spark, d).select("work_id", "chunk_id", F.posexplode("embedding").alias("slot", "n")).filter("n > 0")
    return x.select("work_id", "chunk_id", F.col("slot").cast("long").alias("slot"), F.col("n").cast("long").alias("n"))


def text_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark passage is a query to one work, read up to a chapter that depends on the item; item 0 reads nothing."""
    b = A.table(spark, d, "benchmark")
    works = chapters(spark, d).agg(F.max("work_id")).scalar()
    return b.select(
        F.col("item_id").alias("q_id"), (F.col("item_id") % works + 1).alias("work_id"), (F.col("item_id") * 7 % 60).cast("int").alias("n"), F.col("text").alias("query")
    )


KW = "list_filter(list_distinct(regexp_extract_all(lower({t}), '[a-z0-9]+')), lambda w: length(w) > 2)"


@R.add("f8_keywords", f"SELECT item_id, list_sort({KW.format(t='text')}) AS words FROM benchmark")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "benchmark").select("item_id", F.sort_array(S.keywords(F.col("text"))).alias("words"))


BEST = f"""
st AS (SELECT c.work_id, c.ordinal, generate_subscripts(ss, 1) AS i, regexp_replace(unnest(ss), '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT work_id, ordinal, regexp_extract_all(clean_text, '[^.!?]+[.!?]?') AS ss FROM ch) c),
bs AS (SELECT q.item_id AS q_id, s.work_id, s.ordinal, s.s, row_number() OVER (PARTITION BY s.work_id, s.ordinal ORDER BY len(list_intersect({KW.format(t="s.s")}, {KW.format(t="q.text")})) DESC, s.i) AS rk
       FROM benchmark q JOIN st s ON q.item_id = s.ordinal % (SELECT max(item_id) + 1 FROM benchmark) WHERE s.s <> '')"""


@R.add("f9_best_sentences", query([DOCS, BEST], "SELECT q_id, work_id, ordinal, s AS sentence FROM bs WHERE rk = 1"))
def best_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every chapter answers the one benchmark passage assigned to its ordinal."""
    b = A.table(spark, d, "benchmark")
    c = chapters(spark, d).withColumn("q_id", F.col("ordinal") % b.agg(F.max("item_id") + 1).scalar())
    q = b.select(F.col("item_id").alias("q_id"), S.keywords(F.col("text")).alias("words"))
    return c.join(q, "q_id").select("q_id", "work_id", "ordinal", S.best_sentence(F.col("clean_text"), F.col("words")).alias("sentence"))


ANSWERS = f"""
qs AS (SELECT item_id AS q_id, item_id % (SELECT max(work_id) FROM ch) + 1 AS work_id, CAST(item_id * 7 % 60 AS INTEGER) AS n, text AS query FROM benchmark),
qw AS (SELECT q_id, unnest(regexp_split_to_array(lower(query), '[ \\t\\n\\r]+')) AS w FROM qs),
ql AS (SELECT q_id, CAST(('0x' || right(md5(w), 2)) AS BIGINT) % 64 AS slot, CAST(count(*) AS BIGINT) AS n FROM qw WHERE w <> '' GROUP BY ALL),
cn AS (SELECT work_id, chapter_ordinal, ordinal, sqrt(sum(n * n)) AS nn FROM sl GROUP BY ALL), qn AS (SELECT q_id, sqrt(sum(n * n)) AS nn FROM ql GROUP BY ALL),
pr AS (SELECT q.q_id, q.work_id, c.chapter_ordinal, c.ordinal, q.query, round(coalesce((SELECT sum(a.n * b.n) FROM sl a JOIN ql b ON b.slot = a.slot WHERE b.q_id = q.q_id AND a.work_id = c.work_id
              AND a.chapter_ordinal = c.chapter_ordinal AND a.ordinal = c.ordinal), 0) / (c.nn * n2.nn), 9) AS score FROM qs q JOIN cn c ON c.work_id = q.work_id AND c.chapter_ordinal <= q.n JOIN qn n2 ON n2.q_id = q.q_id),
tq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chapter_ordinal, ordinal) AS rank FROM pr) WHERE rank <= 3),
tx AS (SELECT t.*, substr(k.clean_text, k.char_start + 1, k.char_end - k.char_start) AS text FROM tq t JOIN ck k ON k.work_id = t.work_id AND k.chapter_ordinal = t.chapter_ordinal AND k.ordinal = t.ordinal),
ts AS (SELECT q_id, rank, chapter_ordinal, query, generate_subscripts(ss, 1) AS i, regexp_replace(unnest(ss), '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT *, regexp_extract_all(text, '[^.!?]+[.!?]?') AS ss FROM tx)),
tb AS (SELECT *, row_number() OVER (PARTITION BY q_id, rank ORDER BY len(list_intersect({KW.format(t="s")}, {KW.format(t="query")})) DESC, i) AS rk FROM ts WHERE s <> ''),
an AS (SELECT q_id, string_agg(s || ' [ch' || chapter_ordinal || ']', ' ' ORDER BY rank) AS answer, count(*) AS cited FROM tb WHERE rk = 1 GROUP BY q_id)"""


@R.add(
    "f10_cited_answers",
    query([*CHUNKS, SLOTS, ANSWERS], f"SELECT q.q_id, q.work_id, coalesce(a.answer, {quoted(S.NO_ANSWER)}) AS answer, coalesce(a.cited, 0) AS cited FROM qs q LEFT JOIN an a ON a.q_id = q.q_id", recursive=True),
)
def cited_answers(spark: SparkSession, d: str) -> DataFrame:
    q = text_queries(spark, d).withColumn("embedding", S.hashed_words(F.col("query")))
    index = text_index(spark, d)
    hits = S.top_k(q.select("q_id", "work_id", "n", "embedding"), index, 5, F.floor(F.col("chapter_ordinal") / 32))
    a = S.compose_answers(q, hits, index)
    return a.select("q_id", "work_id", "answer", F.coalesce(F.size("citations"), F.lit(0)).cast("long").alias("cited"))


# ------------------------------------------------------------------ gazetteer tagging


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised benchmark words, alone and with the word after them, labelled by their hash."""
    w = F.split("text", "[ \\n]+")
    pairs = F.zip_with(w, F.array_append(F.slice(w, 2, F.size(w)), F.lit("")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    x = A.table(spark, d, "benchmark").select(F.explode(F.filter(pairs, lambda p: p["a"].rlike("^[A-Z]"))).alias("p"))
    n = x.select(F.explode(F.array(F.col("p.a"), F.concat_ws(" ", "p.a", "p.b"))).alias("s")).select(X.normalize_surface(F.col("s")).alias("norm")).distinct()
    label = F.element_at(F.array(*[F.lit(v) for v in A.LABELS]), (A.hex_int(F.col("norm"), 1, 1) + 1).cast("int"))
    return n.filter("norm <> ''").select("norm", label.alias("label"))


LEX = f"""
bw AS (SELECT item_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, regexp_split_to_array(text, '[ \\n]+') AS ws FROM benchmark)),
bp AS (SELECT a, coalesce(lead(a) OVER (PARTITION BY item_id ORDER BY i), '') AS b FROM bw),
lx AS (SELECT norm, {sql_list(A.LABELS)}[{hex_int("norm", 1, 1)} + 1] AS label FROM (SELECT DISTINCT {norm("s")} AS norm FROM (
        SELECT a AS s FROM bp WHERE regexp_matches(a, '^[A-Z]') UNION ALL SELECT a || ' ' || b FROM bp WHERE regexp_matches(a, '^[A-Z]'))) WHERE norm <> '')"""
_p = "[" + "".join("\\" + c if c.isascii() else c for c in vocab.OUTER_PUNCTUATION) + "]"


def core(w: str) -> str:
    return f"regexp_replace(regexp_replace({w}, {quoted('^' + _p + '+')}, ''), {quoted(_p + '+$')}, '')"



TAGS = f"""
tw AS (SELECT work_id, ordinal, clean_text, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT work_id, ordinal, clean_text, regexp_split_to_array(clean_text, '[ \\n]') AS ws FROM ch)),
tp AS (SELECT *, CAST(sum(length(w) + 1) OVER (PARTITION BY work_id, ordinal ORDER BY i) - length(w) - 1 AS INTEGER) AS s FROM tw),
tf AS (SELECT *, {core("w")} <> '' AS solid, lead({core("w")} <> '') OVER (PARTITION BY work_id, ordinal ORDER BY i) AS solid2,
         lead({core("w")} <> '', 2) OVER (PARTITION BY work_id, ordinal ORDER BY i) AS solid3 FROM tp WHERE w <> ''),
t2 AS (SELECT work_id, ordinal, clean_text, s, s + length(w) AS e1, solid, solid2, solid3, lead(s + length(w)) OVER (PARTITION BY work_id, ordinal ORDER BY i) AS e2,
         lead(s + length(w), 2) OVER (PARTITION BY work_id, ordinal ORDER BY i) AS e3 FROM tf),
tg AS (SELECT work_id, ordinal, s, substr(clean_text, s + 1, e1 - s) AS raw FROM t2 WHERE solid
       UNION ALL SELECT work_id, ordinal, s, substr(clean_text, s + 1, e2 - s) FROM t2 WHERE solid AND solid2
       UNION ALL SELECT work_id, ordinal, s, substr(clean_text, s + 1, e3 - s) FROM t2 WHERE solid AND solid3),
tb AS (SELECT *, {core("raw")} AS surface, s + length(raw) - length(regexp_replace(raw, {quoted('^' + _p + '+')}, '')) AS char_start FROM tg),
ta AS (SELECT t.work_id, t.ordinal AS chapter_ordinal, t.surface, l.label, CAST(t.char_start AS INTEGER) AS char_start FROM tb t JOIN lx l ON l.norm = {norm("t.surface")})"""


@R.add("c1_gazetteer_spans", query([DOCS, LEX, TAGS], "SELECT work_id, chapter_ordinal, surface, label, char_start FROM ta"))
def gazetteer(spark: SparkSession, d: str) -> DataFrame:
    c = chapters(spark, d).select("work_id", F.col("ordinal").alias("chapter_ordinal"), F.lit(0).alias("ordinal"), F.col("clean_text").alias("text"))
    return E.tag_gazetteer(c, lexicon(spark, d)).select("work_id", "chapter_ordinal", "surface", "label", "char_start")


C4 = f"""
cs AS (SELECT s.work_id, s.chapter_ordinal, k.ordinal AS chunk_ordinal, s.surface, s.label, s.char_start, s.char_end, round(s.score * (1 + k.ordinal % 2), 9) AS score FROM spans s
       JOIN ck k ON k.work_id = s.work_id AND k.chapter_ordinal = s.chapter_ordinal AND s.char_start >= k.char_start AND s.char_end <= k.char_end),
bt AS (SELECT *, row_number() OVER (PARTITION BY work_id, chapter_ordinal, char_start, char_end, label ORDER BY score DESC, chunk_ordinal) AS rk FROM cs)"""


@R.add("c4_rebased_spans", query([*CHUNKS, TOKENS, SPANS, C4], "SELECT work_id, chapter_ordinal, chunk_ordinal, surface, label AS type, char_start, char_end, score FROM bt WHERE rk = 1", recursive=True))
def rebased(spark: SparkSession, d: str) -> DataFrame:
    """Spans as a tagger sees them, once per chunk that holds them, odd chunks with twice the score."""
    k = text_index(spark, d).select("work_id", "chapter_ordinal", (F.col("chunk_id") % (1 << 31)).cast("int").alias("ordinal"), "char_start", "char_end")
    score = F.round(F.col("score") * (1 + F.col("chunk_ordinal") % 2), 9)
    local = build.chunk_positions(A.doc_spans(spark, d), k).withColumn("score", score).withColumnRenamed("label", "type")
    return E.rebase_spans(local, k).drop("subtype")


QUERIES, ORACLES = R.queries, R.oracles
