"""Operator 5, WARC: a Python data source that reads and writes web archives.

``spark.read.format("warc").load(folder)`` plans one partition for a group of files.
Predicates on ``record_type`` and ``target_uri`` are pushed into the reader: a
record's header is parsed first, and the block of a record that isn't wanted, or
whose payload isn't asked for (option ``payload``: ``all`` or ``none``), is stepped
over unread. ``df.write.format("warc").mode("append").save(folder)`` writes each
task's records to files of its own, which are moved in place when the job commits;
files of lost attempts are never seen. Files are ``.warc.gz``, a gzip member a record, whose
extra field ``sl`` holds its compressed length, so that the reader inflates a header
alone and steps to the next member; members without it and plain ``.warc`` are read
too. Paths are any that pyarrow.fs opens.

Null target_uri: no such header. Null payload: empty. Line ends in header values
become blanks. Empty folders give no rows.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from quarry.storage import materialise

SCHEMA = "record_id string, record_type string, target_uri string, headers map<string,string>, payload binary"
DATE = "2000-01-01T00:00:00Z"
#: Bytes after which a task starts its next file, bytes of files read by one task, rows of a batch.
FILE_BYTES = 256 << 20
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
#: Bytes read for a header at first and at a time after that; zlib's level.
HEAD_BYTES, READ_BYTES, LEVEL = 2048, 1 << 18, 6


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "all") != "none"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = getattr(f, "attribute", ("",))[0]
            if column in ("record_type", "target_uri") and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.tests.append((column, type(f).__name__, list(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = _filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True))
        out, size = [[]], 0
        for f in sorted((f for f in found if f.base_name.endswith((".warc", ".warc.gz"))), key=lambda f: f.path):
            if out[-1] and size + f.size > self.split:
                out.append([])
                size = 0
            out[-1].append(f.path)
            size += f.size
        return [Files(p) for p in out]

    def wanted(self, headers: dict[str, str]) -> bool:
        value = {"record_type": headers.get("WARC-Type"), "target_uri": headers.get("WARC-Target-URI")}
        for column, kind, x in self.tests:
            v = value[column]
            if v is None or not (v == x if kind == "EqualTo" else v in x if kind == "In" else v.startswith(x)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as f:
                found = members(f, self.wanted, self.payload) if path.endswith(".gz") else records(f, self.wanted, self.payload)
                for headers, payload in found:
                    rows.append((headers.get("WARC-Record-ID"), headers.get("WARC-Type"), headers.get("WARC-Target-URI"), list(headers.items()), payload))
                    size += len(payload or b"") + 500
                    if size > BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["record_id", "record_type", "target_uri", "headers", "payload"])


def records(f, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and payload of the wanted records of an open file; blocks of others are skipped by their length."""
    at, buffer, base = 0, b"", 0
    total = f.size()
    while at < total:
        while (end := buffer.find(b"\r\n\r\n", at - base)) < 0:  # parse the header first
            if base + len(buffer) >= total:
                raise ValueError(f"a record at byte {at} has no end of header")
            f.seek(base + len(buffer))
            buffer += f.read(1 << 16)
        headers = _headers(buffer[at - base : end], at)
        start, length = base + end + 4, int(headers["Content-Length"])
        if wanted(headers):
            block = None
            if payload:
                have = buffer[start - base : start - base + length]
                if len(have) < length:
                    f.seek(start + len(have))
                    have += f.read(length - len(have))
                block = _payload(headers, have)
            yield headers, block
        at = start + length + 4
        cut = min(max(at - base, 0), len(buffer))
        if at - base > len(buffer):
            buffer, base = b"", at
        elif cut > 1 << 15:
            buffer, base = buffer[cut:], at


def _headers(raw: bytes, at: int) -> dict[str, str]:
    first, *lines = raw.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record begins at byte {at}")
    return dict(line.split(": ", 1) for line in lines if ": " in line)


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if headers.get("Content-Type", "").startswith("application/http") else block


def member(data: bytes) -> bytes:
    """A gzip member whose extra field says how long it is, compressed and not."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def members(f, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """As ``records``, for a gzip member a record; only headers of unwanted records are inflated."""
    total, at = f.size(), 0
    source = io.BufferedReader(f, READ_BYTES) if hasattr(f, "readinto") else f
    while at < total:
        source.seek(at)
        fed = source.read(HEAD_BYTES)
        sized = len(fed) >= 24 and fed[3] & 4 and fed[12:16] == b"sl\x08\x00"
        inflate, data, rest, read = zlib.decompressobj(31), b"", fed, len(fed)

        def more(limit: int = 0) -> None:
            nonlocal data, rest, read
            if not rest:
                rest = source.read(READ_BYTES)
                read += len(rest)
                if not rest:
                    raise ValueError(f"the record at byte {at} is cut off")
            data += inflate.decompress(rest, limit)
            rest = inflate.unconsumed_tail

        while (end := data.find(b"\r\n\r\n")) < 0 and not inflate.eof:
            more(HEAD_BYTES)
        headers = _headers(data[:end] if end >= 0 else data, at)
        take = wanted(headers)
        if take and payload or not sized:
            while not inflate.eof:
                more()
        if take:
            yield headers, _payload(headers, data[end + 4 : end + 4 + int(headers["Content-Length"])]) if payload else None
        at += struct.unpack("<I", fed[16:20])[0] if sized else read - len(inflate.unused_data)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.limit = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _filesystem(self.path)
        system.create_dir(f"{root}/_pending", recursive=True)
        out, paths, size = None, [], 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > self.limit:
                    if out:
                        out.close()
                    paths.append(f"{root}/_pending/{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(paths[-1], compression=None), 0
                data = member(record(row))
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(paths)

    def commit(self, messages: list) -> None:
        system, root = _filesystem(self.path)
        for k, m in enumerate(m for m in messages if m):
            for j, p in enumerate(m.paths):
                system.move(p, f"{root}/part-{k:06d}-{j:04d}-{uuid.uuid4().hex[:8]}.warc.gz")

    def abort(self, messages: list) -> None:
        system, _ = _filesystem(self.path)
        for m in messages:
            for p in m.paths if m else ():
                system.delete_file(p)


def record(row: dict) -> bytes:
    """The bytes of one record. A revisit keeps the HTTP head alone."""
    payload = row["payload"] or b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if row["record_type"] == "response":
        block += payload
    head = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": DATE, "WARC-Target-URI": row["target_uri"], "Content-Type": "application/http;msgtype=response"}
    head |= dict(row["headers"] or {}) | {"Content-Length": str(len(block))}
    lines = [f"{k}: {' '.join(str(v).splitlines())}" for k, v in head.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("web archives are appended to; choose a new folder")
        return WarcWriter(self.options)


#: A revisit stands for a payload of this many bytes or more. Shared digests that are broadcast at most (about 100 bytes each).
LEAST_BYTES = 1000
SHARED = 500_000


def archive_pages(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, shared_rows: int = SHARED) -> None:
    """Write one record per page; of equal payloads the one with the largest page_id is the response.

    Digests are grouped before any payload moves; only then pages meet the digests that
    occur more than once: where they are, while there are ``shared_rows`` of these at most,
    else in a shuffle of the payloads that are large enough. A repeated largest page_id is
    a response each time; a null page_id is a revisit where a page with an id has its
    payload, else a response. Null and empty payloads and others that are too small meet nothing.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", html.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    shared = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = materialise(shared, "digests")
    large = rows.where(F.col("size") >= least_bytes).join(F.broadcast(shared) if shared.count() <= shared_rows else shared.hint("merge"), "digest", "left")
    joined = large.unionByName(rows.where(F.col("size") < least_bytes), allowMissingColumns=True)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    headers = F.map_filter(
        F.create_map(
            F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha1:"), "digest"),
            F.lit("X-Payload-Length"), F.col("size").cast("string"),
            F.lit("WARC-Refers-To"), F.when(revisit, name(F.col("first"))),
            F.lit("WARC-Profile"), F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ),
        lambda k, v: v.isNotNull(),
    )
    out = joined.select(
        name(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        headers.alias("headers"),
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def read_archive(spark, path: str, payload: str = "all") -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", payload).load(path)
