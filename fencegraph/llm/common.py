"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids give null."""
    return F.crc32(col.cast("string").cast("binary")) % mod


def tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python a thousand rows at a time: ten thousand, the default, may be a hundred megabytes on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores before it as it takes to differ from the names ``taken`` in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
