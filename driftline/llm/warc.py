"""WARC archives as a chunked record table.

An archive is a Parquet table of rows (record, chunk): the bytes of a record's
rows in order of chunk number, record after record, are a WARC/1.1 file. A
payload is cut into chunks as views of its buffer, and each row carries the
SHA-256 of the payload so far, which the reader compares after every chunk, so
writer, reader and damage reports work chunk by chunk and nothing allocates a
whole record a second time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Workspace, join_hot, ship, with_rows_bounded

CHUNK_BYTES = 1 << 16
#: Bytes of chunk rows that are handed to Spark at once.
EMIT_BYTES = 8 << 20
#: Equal payloads from this size on are stored once.
REVISIT_FROM = 100

SCHEMA = "record long, chunk int, chunks int, data binary, digest string"
_NAMES = ["record", "chunk", "chunks", "data", "digest"]
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def record_head(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """The WARC header and, inside the block, the HTTP header of a record. A
    revisit's block is the HTTP header alone; its Content-Length stays that of
    the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    length = len(http) + (0 if refers_to is not None else size)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {uri}"] if uri else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {length}",
    ]
    return "\r\n".join(lines).encode() + _END + http


def record_chunks(head: bytes, payload: memoryview, size: int = CHUNK_BYTES) -> Iterator[tuple[bytes, str]]:
    """Bytes and running payload digest of each chunk of a record. The head goes
    with the first, the closing line breaks with the last."""
    digest = hashlib.sha256()
    for at in range(0, max(1, len(payload)), size):
        part = payload[at : at + size]
        digest.update(part)
        yield b"".join((head if not at else b"", part, _END if at + size >= len(payload) else b"")), digest.hexdigest()


class RecordReader:
    """Feeds on a record's bytes in pieces of any size; holds its head and no
    payload."""

    def __init__(self) -> None:
        self._head, self._payload, self._left, self._tail = b"", hashlib.sha256(), -1, b""

    def feed(self, data: bytes | memoryview) -> None:
        if self._left < 0:
            self._head += bytes(data)
            first = self._head.find(_END)
            second = self._head.find(_END, first + 4) if first >= 0 else -1
            if second < 0:
                return
            outer, inner = self._head[:first].decode().split("\r\n"), self._head[first + 4 : second].decode().split("\r\n")
            if outer[0] != "WARC/1.1":
                raise ValueError("a record doesn't start with its version")
            self.fields = dict(x.split(": ", 1) for x in outer[1:])
            self.payload_bytes = next(int(x[15:]) for x in inner if x.startswith("Content-Length:"))
            self._left = int(self.fields["Content-Length"]) - (second - first)
            data, self._head = self._head[second + 4 :], b""
        part = memoryview(data)[: self._left]
        self._payload.update(part)
        self._left -= len(part)
        self._tail += bytes(memoryview(data)[len(part) :])

    def running(self) -> str:
        """The digest of the payload so far."""
        return self._payload.hexdigest()

    def result(self) -> tuple:
        """page_id, payload bytes, digest, type and the page referred to; the
        digest of a response is that of the bytes read, and must be the one in
        the head."""
        if self._left != 0 or self._tail != _END:
            raise ValueError("a record is cut short or too long")
        named = self.fields["WARC-Payload-Digest"].removeprefix("sha256:")
        kind = self.fields["WARC-Type"]
        if kind == "response" and self._payload.hexdigest() != named:
            raise ValueError(f"payload of {self.fields['WARC-Record-ID']} doesn't have its digest")
        number = lambda x: None if x is None or x == "<urn:page:none>" else int(x[10:-1])
        return number(self.fields["WARC-Record-ID"]), self.payload_bytes, named, kind, number(self.fields.get("WARC-Refers-To"))


def _write(chunk_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        record = TaskContext.get().partitionId() << 36
        rows, held = [], 0
        for b in batches:
            data = b.column(2)
            for page, url, digest, refers, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), range(b.num_rows), strict=True):
                payload = memoryview(data[k].as_buffer()) if data[k].is_valid else memoryview(b"")
                head = record_head(page, url, len(payload), digest, refers)
                stored = payload if refers is None else memoryview(b"")
                chunks = max(1, -(-len(stored) // chunk_bytes))
                for i, (part, running) in enumerate(record_chunks(head, stored, chunk_bytes)):
                    rows.append((record, i, chunks, part, running))
                    held += len(part)
                    if held >= EMIT_BYTES:
                        yield _rows(rows)
                        rows, held = [], 0
                record += 1
        if rows:
            yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def _read(batches: Iterable[pa.RecordBatch]):
    """Rows sorted by record and chunk, whole records in one partition."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    reader, due = None, 0
    for b in batches:
        out, data = [], b.column(3)
        for record, chunk, chunks, digest, k in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), range(b.num_rows), strict=True):
            if chunk == 0:
                reader, due = RecordReader(), 0
            if reader is None or chunk != due:
                raise ValueError("a chunk is missing")
            reader.feed(memoryview(data[k].as_buffer()))
            if reader.running() != digest:
                raise ValueError(f"chunk {chunk} of record {record} is damaged: its running digest differs")
            due += 1
            if due == chunks:
                out.append(reader.result())
                reader = None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def plan_records(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` of each page: where several
    have the same payload of REVISIT_FROM bytes or more, all but the one with
    the smallest page_id refer to it. Rows that repeat that id, and groups in
    which all ids are null, stay responses."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    twice = rows.where(F.length("payload") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("n", "rows")
    work = Workspace(pages.sparkSession, "warc")
    twice = work.write(twice, "repeated")
    if with_rows_bounded(pages.sparkSession, twice, 100_000):
        out = rows.join(F.broadcast(twice.drop("rows")), "digest", "left")
    else:
        out = join_hot(work, rows, twice.drop("rows"), "digest", ["page_id"], 10_000, sizes=twice)
    return out.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archive(spark: SparkSession, pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write pages as an archive, a chunk table, at ``path``."""
    ship(spark)
    plan_records(pages).mapInArrow(_write(chunk_bytes), SCHEMA).write.parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of
    each record, from its bytes. Records of one chunk are read where they lie;
    only the chunks of longer ones are brought together."""
    ship(spark)
    chunks = spark.read.schema(SCHEMA).parquet(path)
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    whole = chunks.where("chunks = 1").mapInArrow(_read, out)
    long = chunks.where("chunks > 1").repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(_read, out)
    return whole.unionByName(long)


def export_files(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Write the archive at ``path`` as ``.warc`` files in ``folder``, one for
    each partition of whole records, and return their names and sizes. The
    folder is a URI that pyarrow opens on every executor."""
    ship(spark)

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, size = f"part-{TaskContext.get().partitionId():05d}.warc", 0
        with store.open_output_stream(f"{base}/{name}") as to:
            for b in batches:
                for x in b.column(3):
                    size += to.write(memoryview(x.as_buffer())) or len(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], names=["name", "bytes"])

    return spark.read.schema(SCHEMA).parquet(path).repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(run, "name string, bytes long")


def pages_through_warc(spark: SparkSession, pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` in the shared folder and read it
    back: one row per page. Null html is an empty payload, and empty payloads
    are never revisits. Null or repeated page_ids keep their rows. An empty
    table gives an empty one; other columns are ignored."""
    path = Workspace(spark, "warc").path("archive")
    write_archive(spark, pages, path, chunk_bytes)
    return read_archive(spark, path)
