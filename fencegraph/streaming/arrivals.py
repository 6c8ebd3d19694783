"""Arriving chapters, mentions and events as streams; each result equals its batch twin."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fencegraph.functions.lineage import cut
from fencegraph.operators import prep
from fencegraph.operators import relations as T1
from fencegraph.sources.store import GraphStore


def file_stream(spark: SparkSession, path: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def drain(query: StreamingQuery) -> None:
    """Let a query that takes what is available run to its end."""
    query.awaitTermination()


def upsert_chapters(stream: DataFrame, store: GraphStore, checkpoint: str) -> StreamingQuery:
    """Chapter arrivals into the chapters table: same hash skipped, other hash replaced, new ones added.

    Only the folders of arriving works are read, and what is written are the changed chapters and their keys. A batch that is run
    again finds its own hashes and changes nothing, so a restart after a lost driver is safe.
    """

    def apply(batch: DataFrame, _id: int) -> None:
        arriving = cut(prep.first_per_ordinal(batch)[0].drop("src_pos"), "arriving")
        diff = prep.diff_chapters(arriving, store.read_works("chapters", arriving)).filter("action IN ('added', 'updated')")
        changed = cut(arriving.join(diff.select("work_id", "ordinal"), ["work_id", "ordinal"], "left_semi"), "changed")
        if not changed.isEmpty():
            store.replace("chapters", changed.select("work_id", "ordinal"), changed)
            store.compact("chapters")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_entities(stream: DataFrame, store: GraphStore, checkpoint: str) -> StreamingQuery:
    """First chapter and mention count per (work, entity) in update mode; a late earlier chapter lowers the first. The rows that
    a batch changed replace those of before in the table ``running_entities``, so neither table nor reads grow with batches."""
    stats = stream.groupBy("work_id", "entity").agg(F.min("chapter").alias("first_seen_chapter"), F.count(F.lit(1)).alias("mentions"))

    def write(batch: DataFrame, _id: int) -> None:
        now = cut(batch, "entities")
        store.replace("running_entities", now.select("work_id", "entity"), now)
        store.compact("running_entities")

    return stats.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ARRIVING = "work_id long, chapter_ordinal int, version long, mention_id long, node_id long, node_type string, char_start int, char_end int"
_HELD = {"mention_id": "long", "node_id": "long", "node_type": "string", "char_start": "int", "char_end": "int"}
SHELF = 16  # chapters of a work, next to each other, whose state is one row


def merger(keep_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What ``whole_chapters`` does with the rows of a shelf. Its state maps a chapter to the time of its last row, its newest version and
    the mentions of that by id. Mentions are texts that are passed on as they came."""

    def merge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = 0 if keep_ms is None else state.getCurrentProcessingTimeMs()
        shelf = json.loads(state.get[0]) if state.exists else {}
        before: dict[str, tuple] = {}
        for part in () if state.hasTimedOut else parts:
            known = set()
            for chapter, version, mention_id, mention in zip(*(part[c].tolist() for c in ("chapter", "version", "mention_id", "mention")), strict=True):
                kept = shelf.setdefault(chapter, [now, None, {}])
                if chapter not in before:
                    before[chapter] = (kept[1], dict(kept[2]))
                if version is None:
                    continue
                known.add(chapter)
                if kept[1] is None or int(version) > kept[1]:
                    kept[1:] = int(version), {}
                if int(version) == kept[1] and mention_id is not None:
                    kept[2][mention_id] = mention
            if set(part["chapter"]) - known:
                raise ValueError("a chapter came without a version")
        for chapter in before:
            shelf[chapter][0] = now
        if keep_ms is not None:
            shelf = {chapter: kept for chapter, kept in shelf.items() if chapter in before or kept[0] + keep_ms > now}
        if shelf:
            state.update((json.dumps(shelf),))
            if keep_ms is not None:
                state.setTimeoutDuration(max(1, min(kept[0] for kept in shelf.values()) + keep_ms - now))
        else:
            state.remove()
        changed = [chapter for chapter, was in before.items() if was != (shelf[chapter][1], shelf[chapter][2])]
        if changed:
            yield pd.DataFrame({
                "work_id": [key[0]] * len(changed), "chapter": changed, "version": [str(shelf[c][1]) for c in changed],
                "mentions": [f"[{','.join(shelf[c][2].values())}]" for c in changed],
            })

    return merge


def whole_chapters(stream: DataFrame, keep: timedelta | None = None) -> DataFrame:
    """Linked mentions (``ARRIVING``) in any order and number -> all mentions of each chapter that changed.

    The state of a chapter are its newest version and the mentions delivered of it. A chapter may come in parts over many
    batches; a mention delivered again changes nothing; a higher version takes the place of all mentions of lower ones, which are
    ignored from then on. A version without mentions comes, and is answered, as one row without a mention id. With
    ``keep`` the state of a chapter that brings nothing for so long is dropped, and what comes after that is a chapter of its own;
    such a stream needs a trigger by time, as Spark runs it on for the sake of its clock.

    A call of Python costs some milliseconds however few rows it gets, more than the rows of a chapter do, so ``SHELF`` chapters share a
    call and a row of state. Mentions go in and come out as JSON texts, which Spark writes and reads: numbers stay exact beside nulls.
    """
    text = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(_HELD)]))
    packed = stream.select(
        "work_id", F.floor(F.col("chapter_ordinal") / SHELF).alias("shelf"), F.coalesce(F.col("chapter_ordinal").cast("string"), F.lit("")).alias("chapter"),
        F.col("version").cast("string").alias("version"), F.col("mention_id").cast("string").alias("mention_id"), text.alias("mention"),
    )
    keep_ms = None if keep is None else int(keep.total_seconds() * 1000)
    out = packed.groupBy("work_id", "shelf").applyInPandasWithState(
        merger(keep_ms), "work_id long, chapter string, version string, mentions string", "chapters string", "update", GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.ProcessingTimeTimeout
    )
    mentions = F.from_json("mentions", f"array<struct<{', '.join(f'c{i}: {t}' for i, t in enumerate(_HELD.values()))}>>")
    rows = out.select("work_id", F.nullif("chapter", F.lit("")).cast("int").alias("chapter_ordinal"), F.col("version").cast("long").alias("version"), F.explode_outer(mentions).alias("m"))
    return rows.select("work_id", "chapter_ordinal", "version", *[F.col(f"m.c{i}").alias(c) for i, c in enumerate(_HELD)])


def chapter_statistics(stream: DataFrame, store: GraphStore, checkpoint: str, window: int = T1.WINDOW) -> StreamingQuery:
    """Mentions per entity and co-occurrences per pair of each chapter, kept in ``chapter_entities`` and ``chapter_pairs``.

    Pairs never leave a chapter, so a chapter that changed takes back all that it had counted: its rows are replaced, in one step
    for both tables. A batch that is run again replaces them by the same.
    """

    def write(batch: DataFrame, _id: int) -> None:
        now = cut(batch, "chapters")
        if now.isEmpty():
            return
        keys = now.select("work_id", "chapter_ordinal").distinct()
        linked = now.filter("node_id IS NOT NULL")
        counted = linked.groupBy("work_id", "chapter_ordinal", "node_id").agg(F.count(F.lit(1)).alias("mentions"))
        pairs = T1.band_pairs(linked, window).groupBy("work_id", "chapter_ordinal", F.least("a_node_id", "b_node_id").alias("lo"), F.greatest("a_node_id", "b_node_id").alias("hi"))
        with store.change():
            store.replace("chapter_entities", keys, counted)
            store.replace("chapter_pairs", keys, pairs.agg(F.count(F.lit(1)).alias("cooccurrences")))
        for table in ("chapter_entities", "chapter_pairs"):
            store.compact(table)

    return whole_chapters(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pair_totals(per_chapter: DataFrame) -> DataFrame:
    return per_chapter.groupBy("work_id", "lo", "hi").agg(F.sum("cooccurrences").alias("cooccurrences"), F.min("chapter_ordinal").alias("chapter"))


def entity_totals(per_chapter: DataFrame) -> DataFrame:
    return per_chapter.groupBy("work_id", "node_id").agg(F.sum("mentions").alias("mentions"), F.min("chapter_ordinal").alias("first_seen_chapter"))


def without_repeats(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Repeated deliveries of the same key within the delay are dropped; state is bounded by the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def activity(stream: DataFrame, slot: Column, keys: list[str], time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Events per window (tumbling, sliding or session) and key; events later than the watermark are dropped."""
    a = stream.withWatermark(time, delay).groupBy(slot.alias("slot"), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return a.select(F.col("slot.start").alias("start"), F.col("slot.end").alias("end"), *keys, "events", "total")


def to_parquet(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
