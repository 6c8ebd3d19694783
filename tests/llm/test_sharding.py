from collections import defaultdict

from pyspark.sql import functions as F

from fencegraph.llm import sharding


def shards(df, limit):
    return sharding.assign(df, ["doc_id"], F.col("size"), limit).collect()


def test_only_oversized_buckets_split(spark):
    rows = [(i, 100 + i % 7) for i in range(3000)]
    limit = 20_000
    got = shards(spark.createDataFrame(rows, "doc_id long, size long"), limit)
    assert sorted(r.doc_id for r in got) == list(range(3000))
    held = defaultdict(list)
    for r in got:
        held[r.shard].append(r)
    code = {r["doc_id"]: format(r["h"], "060b") for r in spark.range(3000).select(F.col("id").alias("doc_id"), sharding.hash_code(F.col("id")).alias("h")).collect()}
    size = dict(rows)
    for name, members in held.items():
        total = sum(size[r.doc_id] for r in members)
        assert total <= limit and {(r.shard_bytes, r.shard_rows, r.shard_depth) for r in members} == {(total, len(members), len(name))}
        assert all(code[r.doc_id].startswith(name) for r in members)
        parent = [i for i, c in code.items() if c.startswith(name[:-1])]
        assert sum(size[i] for i in parent) > limit  # no bucket was split without need


def test_hot_key_nulls_and_giants(spark):
    rows = [(5, 10)] * 50 + [(None, None), (None, 3), (1, 10**6), (2, 1)]
    df = spark.createDataFrame(rows, "doc_id long, size long").withColumn("shard", F.lit("old"))
    got = shards(df, 100)
    assert len(got) == len(rows)
    hot = [r for r in got if r.doc_id == 5]
    assert {(r.shard_bytes, r.shard_rows, r.shard_depth) for r in hot} == {(500, 50, 60)}  # one code: no bit can part it
    split = sharding.assign(df.withColumn("row", F.monotonically_increasing_id()), ["doc_id", "row"], F.col("size"), 100)
    assert max(r.shard_bytes for r in split.where("doc_id = 5").collect()) <= 100


def test_one_shard_none_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (2, 2)], "doc_id long, size long")
    assert {(r.shard, r.shard_depth) for r in shards(df, 10)} == {("*", 0)}
    assert shards(df.where("false"), 10) == []
    sharding.write(sharding.assign(df, ["doc_id"], F.col("size"), 2), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
