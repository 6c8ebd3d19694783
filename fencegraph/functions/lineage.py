"""Lineage cuts and scratch tables in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder on a local master, else an error: on a
    cluster every executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The plan starts afresh there, survives the loss of executors, and later readers
    get column pruning and true sizes (a binary checkpoint offers neither).
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STORED: dict[tuple[str, ...], tuple[str, StructType]] = {}
BUILD_SECONDS: dict[str, float] = {}  # of derived tables, without those built inside them
_inner: list[float] = []


def stored(spark: SparkSession, key: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table built once per application and read many times, as a graph build is."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _STORED or not _complete(spark, _STORED[full][0]):
        began = time.time()
        _inner.append(0.0)
        df = build()
        path = scratch(spark, key[0])
        df.write.option("compression", "zstd").parquet(path)
        _STORED[full] = (path, df.schema)
        took = time.time() - began
        BUILD_SECONDS[key[0]] = BUILD_SECONDS.get(key[0], 0.0) + took - _inner.pop()
        if _inner:
            _inner[-1] += took
    path, schema = _STORED[full]
    return spark.read.schema(schema).parquet(path)


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a written table is still there (scratch folders may be cleared between reads)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
