"""The registered queries of this subpackage, each a thin use of its operator over a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fencegraph.catalog.registry import Registry
from fencegraph.functions.lineage import scratch
from fencegraph.llm import ann, bpe, decontaminate, langid, phrases, pivots, secrets, sharding, simhash, toxicity, warc, whitening, wordpack
from fencegraph.llm.common import id_remainder, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def language_model(spark: SparkSession, sf_dir: str) -> langid.Network:
    """Trained on documents that are not held out (crc32 of the id modulo 5 is not 0)."""
    learn = table(spark, sf_dir, "documents").where(id_remainder(F.col("doc_id"), 5) != 0)
    return langid.fit(learn, "text", "lang", F.xxhash64("doc_id"))


@R.add("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = langid.predict(docs, "text", language_model(spark, sf_dir))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@R.add("op3_simhash_groups")
def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@R.add("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", *how)
    back = bpe.decode(coded, "ids", *how)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@R.add("op2_simple8b_tokens")
def op2_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    wordpack.write(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), path, end=1)
    return wordpack.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


SHARD_BYTES = 1 << 20


@R.add(
    "op5_extendible_shards",
    f"""
WITH d AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h,
                  coalesce(strlen(text), 0) AS b FROM documents),
lv AS (SELECT i AS depth, h >> (60 - i) AS bits, CAST(sum(b) AS BIGINT) AS shard_bytes, count(*) AS shard_rows
       FROM d, range(0, 61) r(i) GROUP BY ALL),
fit AS (SELECT a.* FROM lv a LEFT JOIN lv u ON u.depth = a.depth - 1 AND u.bits = a.bits >> 1
        WHERE (a.shard_bytes <= {SHARD_BYTES} OR a.depth = 60) AND (u.depth IS NULL OR u.shard_bytes > {SHARD_BYTES}))
SELECT doc_id, CASE WHEN depth = 0 THEN '*' ELSE substr(lpad(bin(bits), 64, '0'), 65 - depth) END AS shard,
       CAST(depth AS INTEGER) AS shard_depth, shard_bytes, shard_rows
FROM d JOIN fit ON fit.bits = d.h >> (60 - fit.depth)
""",
)
def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return sharding.assign(docs, ["doc_id"], F.col("size"), SHARD_BYTES).drop("size")


@R.add("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    count = [secrets.count_of(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    every = F.array_sort(F.concat("base", "added"))
    return seen.select("doc_id", *count, F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.listed(every).alias("spans"))


@R.add("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item that leaked into it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", "l.score", "l.first", "l.stop")


@R.add("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    scored = toxicity.score(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "toxic", ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@R.add(
    "op4_warc_records",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS head FROM p GROUP BY h)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(5 * i // 4 + 1 AS BIGINT), 2) AS INTEGER) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to
FROM p JOIN m USING (h)
""",
)
def op4_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams, members = scratch(spark, "warc"), scratch(spark, "warc-members")
    warc.write(table(spark, sf_dir, "pages"), "page_id", "url", "html", streams)
    warc.rewrite(spark, streams, members)
    return warc.read(spark, members).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


@R.add("op1_learned_partitions")
def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5)


@R.add("op11_pivot_permutations")
def op11_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.groups(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", least=0.98)


@R.add("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("deviation", F.col("deviation").cast("long"))


@R.add(
    "op12_phrases",
    r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, s.s AS size, unnest(list_transform(range(1, len(w) - s.s + 2), lambda i: array_to_string(w[i:i + s.s - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS s) s WHERE len(w) >= s.s),
f AS (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT c.lang, c.phrase, c.a, c.size, t.k, array_to_string(w[1:t.k], ' ') AS head, array_to_string(w[t.k + 1:], ' ') AS tail FROM c, (SELECT unnest([1, 2]) AS k) t WHERE t.k < c.size),
s AS (SELECT k.lang, k.phrase, k.a, k.size, k.k, l.f AS l, r.f AS r, (1000000 * k.a * k.a) // (l.f * r.f) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.head JOIN f r ON r.lang = k.lang AND r.phrase = k.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS b FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE size = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE size = 3) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.b IS NULL OR 100 * i.b < 50 * b.a)
SELECT o.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
""",
)
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), "text", "lang")
