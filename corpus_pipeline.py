"""From raw documents to token ids: five stages, each an operator of ``fencegraph.llm`` over all that the one before kept.

Stages take and return the columns of ``documents`` (the last one returns token ids). Null ids, null, empty and repeated rows
pass through every stage by the rules in its docstring, further columns of any name and type stay until the last; an empty table
stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fencegraph.functions.lineage import cut
from fencegraph.llm import bpe, decontaminate, langid, secrets, simhash
from fencegraph.llm.common import fresh
from fencegraph.llm.queries import language_model

LEAST_LANGUAGE_SCORE = 0.4
TOKENIZER = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too) and those of no language with a mean probability of
    ``LEAST_LANGUAGE_SCORE``; the column ``lang`` keeps what the source says. Without any label to learn from, no language is
    known and no document stays."""
    lang, score = fresh("lang_pred", docs.columns), fresh("lang_score", docs.columns)
    labelled = langid.predict(docs, "text", language_model(spark, sf_dir), lang_col=lang, score_col=score)
    return labelled.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once (of rows that repeat its id in the group,
    that with the smallest hash of all its columns). Rows without an id stand for no group and stay."""
    inner = [{"doc_id": "doc_id", "text": "text"}.get(c, f"c{i}") for i, c in enumerate(docs.columns)]
    plain = docs.toDF(*inner)
    maps = {f.name for f in plain.schema if "map<" in f.dataType.simpleString()}  # which have no hash
    mark = F.xxhash64(*[F.to_json(F.struct(c)) if c in maps else F.col(c) for c in inner])
    found = simhash.groups(plain, "doc_id", "text", mark.alias("mark"))
    first = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("id"), "fp").agg(F.min("mark").alias("kept"))
    rows = plain.withColumn("mark", mark).join(first, (F.col("doc_id") == F.col("id")) & (F.col("mark") == F.col("kept")), "left_semi")
    once = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("mark"))).where("nth = 1")  # rows alike in all columns
    return once.select(*inner).unionByName(plain.where("doc_id IS NULL")).toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents into which an item of ``benchmark`` leaked."""
    benchmark, out = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), fresh("leaks", docs.columns)
    return decontaminate.find(docs, "text", benchmark, "item_id", "text", out=out).where(F.size(out) == 0).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts, all documents stay; ``n_chars`` follows the text."""
    base, added = fresh("base", docs.columns), fresh("added", docs.columns)
    masked = secrets.redact(secrets.scan(docs, "text", base, added), "text", base=base, added=added)
    changed = F.size(base) + F.size(added) > 0
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the sha256 of the bytes that the ids decode to. The ids are written before they
    are decoded: in one stage every task would hold a Python process for each, with all that earlier stages left in it."""
    coded = cut(bpe.encode(docs.select("doc_id", "lang", "source", "text"), "text", *TOKENIZER), "ids")
    return bpe.decode(coded, "ids", *TOKENIZER).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("encoding", token_ids),
]
ORACLE_SQL = None  # a trained network, alignments and BPE are not SQL; tests/llm/test_pipeline.py restates the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
