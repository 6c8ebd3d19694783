"""The tables of the graph as Parquet under one folder, with snapshots: a change writes rows in proportion to itself, and shows
in one step.

A table is a list of parts: folders of rows, and folders of keys whose older rows are gone. Reading a table puts its rows
together and leaves out, by anti joins, those that keys of a later change name. A snapshot is one small file that lists
the parts of every table; the latest whole one counts. A change writes its parts first and its snapshot last, so a crash anywhere
leaves the snapshot before it as it was. Changes inside ``with store.change():`` share one snapshot.

Rows are laid out by work bucket (and tier, for edges), so reads of some works prune folders. ``compact`` merges parts and takes
the number of buckets from the number of rows; ``vacuum`` removes what no kept snapshot lists. One writer at a time: a second one
meets the file of its snapshot and fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fencegraph.functions.lineage import cut
from fencegraph.operators.fence import visible_edges, with_effective_reveal
from fencegraph.schema import INTERNAL, STORED, TABLES

CHAPTER_DEPENDENTS = ["chunks", "mentions", "vectors", "chapter_entities", "chapter_pairs"]
LAYOUT = {"edges": ["tier", "work_bucket"], "vectors": ["cell"]}  # folders by what is read or rewritten together; else by bucket
ROWS_PER_BUCKET, MOST_BUCKETS = 1_000_000, 4096
PARTS = 12  # of a table, above which ``compact`` merges

Part = dict  # folder, seq, and either buckets (of rows) or on (columns of keys)


class GraphStore:
    """Typed tables with snapshots under ``root``; ``buckets`` is used for rows written before a count is known."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root = spark, root
        self.buckets: int = self.state().get("buckets", buckets)  # those that the store began with
        self._open: dict | None = None  # the state inside a change
        self._depth = 0

    # -------------------------------------------------------------- snapshots

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def snapshots(self) -> list[int]:
        """Numbers of the snapshot files, whole or not, rising."""
        fs, p = self._fs(f"{self.root}/_snapshots")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def state(self, snapshot: int | None = None) -> dict:
        """Parts by table, of the latest whole snapshot or of one by number."""
        for n in reversed(self.snapshots()) if snapshot is None else [snapshot]:
            fs, p = self._fs(f"{self.root}/_snapshots/{n:09d}.json")
            stream = fs.open(p)
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            try:
                return json.loads(text)
            except ValueError:  # a writer died over this file
                if snapshot is not None:
                    raise
        return {"seq": 0, "tables": {}}

    def _publish(self, state: dict) -> None:
        number = max([0, *self.snapshots()]) + 1
        fs, p = self._fs(f"{self.root}/_snapshots/{number:09d}.json")
        out = fs.create(p, False)  # fails if another writer was first
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    @contextmanager
    def change(self) -> Iterator[None]:
        """What is written inside shows at once when the block ends, and not at all if it raises."""
        if self._open is None:
            self._open = self.state() | {"buckets": self.buckets}
            self._nodes_before, self._stale = list(self._parts("nodes")), False
        self._depth += 1
        try:
            yield
            if self._depth == 1:
                if self._stale:
                    self._restamp()
                self._publish(self._open)
        finally:
            self._depth -= 1
            if self._depth == 0:
                self._open = None

    def _parts(self, table: str, snapshot: int | None = None) -> list[Part]:
        state = self._open if self._open is not None and snapshot is None else self.state(snapshot)
        return state["tables"].get(table, [])

    # -------------------------------------------------------------- parts

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def schema(self, table: str) -> str:
        return ", ".join([(TABLES | INTERNAL)[table], *([STORED[table]] if table in STORED else [])])

    def _layout(self, table: str) -> list[str]:
        return LAYOUT.get(table, ["work_bucket"])

    def _new(self, table: str, **more: object) -> Part:
        self._open["seq"] += 1  # parts of one change follow each other too
        part = {"folder": f"seq={self._open['seq']}/part={uuid.uuid4().hex[:12]}", "seq": self._open["seq"], **more}
        self._open["tables"][table] = [*self._parts(table), part]
        return part

    def _write_rows(self, table: str, df: DataFrame, buckets: int) -> None:
        typed = df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in self.schema(table).split(", ")])
        placed = typed.withColumn("work_bucket", F.pmod("work_id", F.lit(buckets)).cast("int"))
        # rebalance: one writer per folder, and a bucket that is too large is split over several
        placed = placed.hint("rebalance", *self._layout(table))
        if "work_bucket" not in self._layout(table):
            placed = placed.sortWithinPartitions(*self._layout(table), "work_id")
        if table in STORED:  # row groups then cover few positions each, which a fence skips by their statistics
            placed = placed.sortWithinPartitions(*self._layout(table), "effective_reveal")
        part = self._new(table, buckets=buckets)
        placed.write.mode("overwrite").partitionBy(*self._layout(table)).parquet(f"{self.path(table)}/{part['folder']}")

    def _write_gone(self, table: str, keys: DataFrame) -> None:
        part = self._new(table, on=keys.columns)
        types = {c.split()[0]: c.split()[1] for c in self.schema(table).split(", ")}
        keys.select(*[F.col(c).cast(types[c]) for c in keys.columns]).distinct().write.mode("overwrite").parquet(f"{self.path(table)}/{part['folder']}")

    def _put_together(self, table: str, parts: list[Part], merge: list[Part] | None = None) -> DataFrame:
        """Rows of ``merge`` (all row parts if not given) without those that key parts of ``parts`` name, with work_bucket and part."""
        rows = [p for p in (merge if merge is not None else parts) if "buckets" in p]
        schema = self.schema(table) + ", work_bucket int, seq long, part string"
        if not rows:
            return self.spark.createDataFrame([], schema).drop("seq")
        out = self.spark.read.schema(schema).option("basePath", self.path(table)).parquet(*[f"{self.path(table)}/{p['folder']}" for p in rows])
        types = {c.split()[0]: c.split()[1] for c in self.schema(table).split(", ")}
        oldest = min(p["seq"] for p in rows)
        for on in {tuple(p["on"]) for p in parts if "on" in p and p["seq"] > oldest}:
            keys = self.spark.read.schema(", ".join(f"{c} {types[c]}" for c in on) + ", seq long").option("basePath", self.path(table))
            keys = keys.parquet(*[f"{self.path(table)}/{p['folder']}" for p in parts if p.get("on") == list(on)])
            keys = keys.select(*[F.col(c).alias(f"__{c}") for c in on], F.col("seq").alias("__seq"))
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
            out = out.join(keys, same & (F.col("__seq") > F.col("seq")), "left_anti")
        return out.drop("seq")

    # -------------------------------------------------------------- reads

    def read(self, table: str, snapshot: int | None = None) -> DataFrame:
        return self._put_together(table, self._parts(table, snapshot)).drop("part")

    def rows(self, table: str, snapshot: int | None = None) -> DataFrame:
        return self.read(table, snapshot).drop("work_bucket")

    def read_works(self, table: str, rows: DataFrame) -> DataFrame:
        """Only the folders that hold the works of ``rows``; their list is bounded by the number of buckets."""
        parts = self._parts(table)
        wanted = F.lit(False)
        for k in {p["buckets"] for p in parts if "buckets" in p}:
            buckets = [r[0] for r in rows.select(F.pmod("work_id", F.lit(k)).cast("int")).distinct().collect()]
            wanted = wanted | (F.col("part").isin([p["folder"].rpartition("=")[2] for p in parts if p.get("buckets") == k]) & F.col("work_bucket").isin(buckets))
        return self._put_together(table, parts).filter(wanted).drop("part")

    def scan(self, table: str, work_id: int, order: list[str]) -> DataFrame:
        """Ordered scan of one work: the bucket predicate prunes folders."""
        one = self.spark.createDataFrame([(work_id,)], "work_id long")
        return self.read_works(table, one).filter(F.col("work_id") == work_id).drop("work_bucket").orderBy(*order)

    def counts(self, table: str) -> DataFrame:
        return self.read(table).groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))

    def visible_edges(self, n: int) -> DataFrame:
        """Edges that show at a reading position: one comparison on a stored column, which reaches the scan."""
        return visible_edges(self.rows("edges"), self.rows("nodes"), n)

    # -------------------------------------------------------------- changes

    def write(self, table: str, df: DataFrame) -> None:
        """Replace a whole table. Edges are stamped with the nodes that are stored by then."""
        with self.change():
            new = self.stamped(df) if table == "edges" else df
            before = self._parts(table)
            self._write_rows(table, new, self.buckets)
            self._open["tables"][table] = [p for p in self._parts(table) if p not in before]
            self._stale = table == "nodes" or (self._stale and table != "edges")

    def append(self, table: str, df: DataFrame) -> None:
        with self.change():
            self._write_rows(table, self.stamped(df) if table == "edges" else df, self.buckets)
            self._stale = self._stale or table == "nodes"

    def delete_rows(self, table: str, keys: DataFrame) -> None:
        """Delete rows that match ``keys`` on all its columns, nulls too: the keys are written, no row is."""
        with self.change():
            if any("buckets" in p for p in self._parts(table)):
                self._write_gone(table, keys)
                self._stale = self._stale or table == "nodes"

    def replace(self, table: str, keys: DataFrame, df: DataFrame) -> None:
        """Rows that match ``keys`` make way for ``df``. Both may read the table as it was."""
        with self.change():
            self.delete_rows(table, keys)
            self.append(table, df)

    def stamped(self, edges: DataFrame) -> DataFrame:
        """Edges with ``effective_reveal`` from the stored nodes; none where an end is not stored, so the edge shows nowhere."""
        return with_effective_reveal(edges.drop("effective_reveal"), self.rows("nodes"), dangling=True)

    def _restamp(self) -> None:
        """Stamp anew the edges one of whose ends was added, removed, or is revealed at another chapter than before."""
        if not any("buckets" in p for p in self._parts("edges")):
            return
        state = lambda df, name: df.groupBy(F.col("node_id").alias(f"__{name}")).agg(F.max("revealed_chapter").alias(name))
        old, new = state(self._put_together("nodes", self._nodes_before), "old"), state(self.rows("nodes"), "new")
        moved = old.join(new, F.col("__old") == F.col("__new"), "full").filter(F.col("__old").isNull() | F.col("__new").isNull() | ~F.col("old").eqNullSafe(F.col("new")))
        moved = cut(moved.select(F.coalesce("__old", "__new").alias("__moved")), "moved")
        edges = self.rows("edges")
        hit = edges.join(moved.withColumnRenamed("__moved", "__s"), F.col("source_id") == F.col("__s"), "left").join(moved.withColumnRenamed("__moved", "__t"), F.col("target_id") == F.col("__t"), "left")
        hit = hit.filter(F.col("__s").isNotNull() | F.col("__t").isNotNull()).drop("__s", "__t").withColumnRenamed("effective_reveal", "__was")
        late = cut(self.stamped(hit).filter(~F.col("effective_reveal").eqNullSafe(F.col("__was"))).drop("__was"), "restamped")
        if not late.isEmpty():
            self._write_gone("edges", late.select("work_id", "edge_id"))
            self._write_rows("edges", late, self.buckets)

    def delete_works(self, works: DataFrame, tables: list[str] | None = None) -> None:
        """Remove works from every table (cascade), in one step."""
        keys = cut(works.select("work_id").distinct(), "gone")
        with self.change():
            for t in tables or [*TABLES, *INTERNAL]:
                self.delete_rows(t, keys)

    def delete_chapters(self, keys: DataFrame) -> None:
        """Remove chapters with their chunks and mentions; keys are (work_id, ordinal)."""
        k = cut(keys.select("work_id", "ordinal").distinct(), "gone")
        with self.change():
            self.delete_rows("chapters", k)
            for t in CHAPTER_DEPENDENTS:
                self.delete_rows(t, k.withColumnRenamed("ordinal", "chapter_ordinal"))

    def delete_nodes(self, ids: DataFrame) -> None:
        """Remove nodes with their edges and properties; their mentions stay and lose the link. Ids are unique over all works."""
        k = cut(ids.select("node_id").distinct(), "gone")
        with self.change():
            stale = self._stale
            for t in ("nodes", "node_properties"):
                self.delete_rows(t, k)
            self._stale = stale  # the edges of these nodes go with them, so none is left to stamp anew
            for end in ("source_id", "target_id"):
                self.delete_rows("edges", k.withColumnRenamed("node_id", end))
            unlinked = cut(self.rows("mentions").join(k, "node_id", "left_semi").withColumn("node_id", F.lit(None).cast("long")), "unlinked")
            self.delete_rows("mentions", k)
            if not unlinked.isEmpty():
                self.append("mentions", unlinked)

    def replace_tier(self, tier: int, edges: DataFrame, works: DataFrame | None = None) -> None:
        """Rebuild one tier of ``works`` (those of ``edges`` if not given; a work that is named and has no new edge loses the
        tier). Other works and tiers keep their rows."""
        new = cut(edges.filter(F.col("tier") == tier), "tier")
        rebuilt = (works if works is not None else new).select("work_id", F.lit(tier).alias("tier")).distinct()
        self.replace("edges", rebuilt, new)

    # -------------------------------------------------------------- upkeep

    def compact(self, table: str, parts: int = PARTS) -> bool:
        """Merge parts of a table that has more than ``parts``: the newest ones, as many as are not much larger than what
        comes after them, so a row is merged again a number of times that grows with the logarithm of the table. All are merged,
        and keys leave, where keys make half of the parts."""
        now = self._parts(table)
        if len(now) <= parts:
            return False
        rows = [p for p in now if "buckets" in p]
        first = 0
        if len(rows) > len(now) / 2:
            sizes = [self.spark.read.parquet(f"{self.path(table)}/{p['folder']}").count() for p in rows]  # of file footers
            first = next(i for i in range(len(rows)) if sizes[i] <= 2 * sum(sizes[i + 1 :]) or i >= len(rows) - 2)
        merged = rows[first:]
        with self.change():
            df = self._put_together(table, now, merged).drop("part", "work_bucket")
            total = df.count()
            self._open["tables"][table] = rows[:first] + ([p for p in now if "on" in p] if first else [])
            self._write_rows(table, df, max(1, min(MOST_BUCKETS, -(-total // ROWS_PER_BUCKET))))
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Remove parts that none of the last ``keep`` snapshots lists, and older snapshots."""
        numbers = self.snapshots()
        kept = [self.state(n) for n in numbers[-keep:]]
        for n in numbers[:-keep]:
            fs, p = self._fs(f"{self.root}/_snapshots/{n:09d}.json")
            fs.delete(p, False)
        for table in {t for s in kept for t in s["tables"]} | {*TABLES, *INTERNAL}:
            live = {p["folder"] for s in kept for p in s["tables"].get(table, [])}
            fs, top = self._fs(self.path(table))
            for seq in fs.listStatus(top) if fs.exists(top) else []:
                for part in fs.listStatus(seq.getPath()):
                    if f"{seq.getPath().getName()}/{part.getPath().getName()}" not in live:
                        fs.delete(part.getPath(), True)


def get_or_create_works(works: DataFrame, wanted: DataFrame) -> DataFrame:
    """``works`` plus one row per wanted slug that is not there yet; ids continue in slug order."""
    from fencegraph.functions.ranking import number_by_range

    new = wanted.groupBy("slug").agg(F.min("title").alias("title")).join(works.select("slug"), "slug", "left_anti")
    numbered = number_by_range(new.withColumn("__all", F.lit(1)), ["__all"], ["slug"], "no").drop("__all")
    top = works.agg(F.coalesce(F.max("work_id"), F.lit(0))).scalar()
    return works.select("work_id", "slug", "title").unionByName(
        numbered.select((top + F.col("no")).alias("work_id"), "slug", "title")
    )
