"""WARC archives: records in one gzip stream, normalised to a member per record with an offset index.

Crawls are often kept as one gzip stream over a whole file, in which no record can be reached without inflating all before
it. The normaliser inflates such a file once, as a stream, writes every record as a gzip member of its own, and notes where
each begins and how long it is. With that sidecar index any record is read alone.

An archive is a row (name, bytes) of a table that Spark writes and commits, of bounded size, so archives lie wherever Spark
can write, many are worked on at once, and a lost executor leaves none behind half written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fencegraph.functions.lineage import cut
from fencegraph.llm.common import small_batches

ARCHIVE_BYTES = 4 << 20  # payload after which an archive is closed
STEP = 1 << 20  # bytes inflated at a time
# Fixed values of the format.
VERSION, DATE = "WARC/1.1", "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Record(NamedTuple):
    headers: dict[str, str]  # names in lower case
    block: bytes


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; line ends and control characters in a header value become spaces."""
    clean = ("".join(c if c >= " " and c != "\x7f" else " " for c in v) for _, v in headers)
    lines = [VERSION, *(f"{n}: {v}" for (n, _), v in zip(headers, clean)), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {n.lower(): v.strip() for n, _, v in (line.partition(":") for line in lines[1:])}
    return Record(headers, rest[: int(headers["content-length"])])


def inflated(stream: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, a bounded piece at a time."""
    rest = stream
    while rest:
        d = zlib.decompressobj(31)
        while not d.eof:
            piece = d.decompress(rest, STEP)
            rest = d.unconsumed_tail
            if piece:
                yield piece
            elif not rest and not d.eof:
                raise ValueError("gzip stream ends early")
        rest = d.unused_data


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; no more is held than the record at hand."""
    held, need = bytearray(), 0
    for piece in pieces:
        held += piece
        while True:
            if not need:
                head = held.find(b"\r\n\r\n")
                if head < 0:
                    break
                fields = bytes(held[:head]).split(b"\r\n")
                length = next((int(f.split(b":", 1)[1]) for f in fields if f.lower().startswith(b"content-length:")), None)
                if length is None or not fields[0].startswith(b"WARC/"):
                    raise ValueError("no WARC record")
                need = head + 4 + length + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("WARC file ends inside a record")


def normalise(stream: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """A file of one member per record, and the offset and length of each member."""
    out, index = bytearray(), []
    for raw in records(inflated(stream)):
        d = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = d.compress(raw) + d.flush()
        index.append((len(out), len(member)))
        out += member
    return bytes(out), index


def _heads(pages: DataFrame) -> DataFrame:
    """(page_id, digest, head): of each page that is not the last with its payload, the id of that one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [x.as_py() or b"" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest_of(p) for p in payloads], pa.string()), pa.array([len(p) for p in payloads], pa.int64())], names=["page_id", "digest", "n"])

    seen = cut(pages.select("page_id", F.col("html").cast("binary").alias("html")).mapInArrow(work, "page_id long, digest string, n long").distinct(), "digests")
    last = seen.groupBy("digest", "n").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("pages")).where("pages > 1")
    return seen.join(last, ["digest", "n"]).where("NOT (page_id <=> head)").select("page_id", "digest", "n", "head")


def write(pages: DataFrame, page_id: str, url: str, html: str, path: str, *, least_bytes: int = 0) -> None:
    """Archives of one gzip stream each at ``path``, a record per row of ``pages``.

    Of rows with equal payloads of ``least_bytes`` or more, that with the largest id is the response, which the others
    revisit; rows that repeat id and payload of the response are responses as well, and a null id revisits any other. Null
    html is an empty payload, a null url an empty one. Other columns are ignored; an empty table writes no archive.
    """
    small_batches(pages.sparkSession)
    plain = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(url, F.lit("")).alias("url"), F.col(html).alias("html"))
    heads = _heads(plain).where(F.col("n") >= least_bytes).groupBy("page_id", "digest").agg(F.max("head").alias("head"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest_of(x.as_py() or b"") for x in batch.column(2)], pa.string())], names=[*batch.schema.names, "digest"])

    full = plain.withColumn("html", F.col("html").cast("binary")).mapInArrow(digests, "page_id long, url string, html binary, digest string")
    decided = full.join(heads.withColumnRenamed("page_id", "id").withColumnRenamed("digest", "d"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "digest", "head")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held = TaskContext.get().partitionId(), 0, 0
        stream, parts = zlib.compressobj(6, zlib.DEFLATED, 31), []

        def closed() -> pa.RecordBatch:
            parts.append(stream.flush())
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:05d}-{number:05d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], names=["name", "content"])

        for batch in batches:
            for page, target, payload, digest, head in zip(*(c.to_pylist() for c in batch.columns)):
                payload = payload or b""
                headers = [("WARC-Type", "response" if head is None else "revisit"), ("WARC-Record-ID", record_id(f"page:{page}")), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
                headers += [] if page is None else [("X-Page-ID", str(page))]
                headers += [] if head is None else [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(f"page:{head}")), ("X-Refers-To-Page-ID", str(head))]
                parts.append(stream.compress(serialise(headers, payload if head is None else b"")))
                held += len(payload) + 512
                if held >= ARCHIVE_BYTES:
                    yield closed()
                    stream, parts, held, number = zlib.compressobj(6, zlib.DEFLATED, 31), [], 0, number + 1
        if held:
            yield closed()

    decided.mapInArrow(archive, "name string, content binary").write.parquet(path)


def rewrite(spark: SparkSession, path: str, out: str) -> None:
    """Normalise every archive at ``path`` to ``out``, each with its sidecar index beside it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, index = normalise(content.as_py())
                pairs = pa.array([[{"at": a, "length": n} for a, n in index]], pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary()), pairs], names=["name", "content", "index"])

    spark.read.parquet(path).select("name", "content").mapInArrow(work, "name string, content binary, index array<struct<at:bigint,length:bigint>>").write.parquet(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the normalised archives at ``path``, each inflated alone at its place in the index: name, at, type,
    page_id, url, digest, payload_bytes, refers_to, payload (that of a revisit is empty). A payload that does not have the
    digest of its record is an error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, index = batch.column(0)[row].as_py(), batch.column(2)[row].as_py()
                content = memoryview(batch.column(1)[row].as_buffer())
                for lo in range(0, len(index), 256):
                    rows = [_row(name, i["at"], parse(zlib.decompress(content[i["at"] : i["at"] + i["length"]], 31))) for i in index[lo : lo + 256]]
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return spark.read.parquet(path).select("name", "content", "index").mapInArrow(work, "name string, at long, type string, page_id long, url string, digest string, payload_bytes long, refers_to long, payload binary")


_SCHEMA = pa.schema([("name", pa.string()), ("at", pa.int64()), ("type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _row(name: str, at: int, r: Record) -> dict[str, object]:
    h = r.headers
    digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
    if kind == "response" and digest_of(r.block) != digest:
        raise ValueError(f"{name}: payload of the record at {at} does not have its digest")
    number = lambda key: int(h[key]) if key in h else None
    return {"name": name, "at": at, "type": kind, "page_id": number("x-page-id"), "url": h["warc-target-uri"], "digest": digest, "payload_bytes": number("x-payload-length"), "refers_to": number("x-refers-to-page-id"), "payload": r.block}
