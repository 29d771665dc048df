"""WARC archives as a PySpark data source (format ``warc``).

Writing: each task writes gzip members, one a record, into files of bounded
size; the names it wrote reach the driver, which commits them in a manifest of
this write, so files of failed or repeated attempts are never read.  Appending
adds a manifest; overwriting puts one in place of all others and removes their
files.  A member's gzip header carries its lengths (the ``sl`` field of the
WARC annex).

Reading: a partition is a file.  Filters on the record type and on headers are
pushed down; the reader inflates a record's head first and, when the filters
turn it down or payloads are not asked for (option ``payload=false``), jumps to
the next member without inflating the rest.  Archives without the field, or not
compressed, are read too, also beside files of this writer.  An archive that
ends within a record or member, or whose checksums do not hold, is an error
that names file and offset.

Rows: ``record_id, record_type, target_uri, payload_digest, refers_to,
payload_bytes, payload``.  A revisit has no payload of its own; its digest and
byte count are those of the record it refers to.

Edge cases: a null payload is empty; null headers are left out and read back as
null; line breaks in a header value are percent-encoded; repeated rows are
records of their own; an empty table writes an empty manifest and reads as no
rows.  Extra columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage,
)

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
_ARROW = pa.schema([*((n, pa.string()) for n in ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
#: Columns that record heads can answer for.
HEADERS = ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")
MANIFEST = "_manifest-"
#: Names of this writer's files; others in a folder are archives from elsewhere.
OWN = re.compile(r"part-[0-9a-f]{32}\.warc\.gz")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file is closed once it has so many bytes, so that a reading task is bounded.
ROLL_BYTES = 64 << 20
HEAD = 4096


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(record_id: str | None, record_type: str, target_uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A WARC record; a revisit keeps the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", target_uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if record_type == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("X-Payload-Bytes", str(len(payload))), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that tells its own compressed and plain length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    lengths = min(total, 0xFFFFFFFF).to_bytes(4, "little") + min(len(data), 0xFFFFFFFF).to_bytes(4, "little")
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + (12).to_bytes(2, "little") + b"sl" + (8).to_bytes(2, "little") + lengths
    return head + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.overwrite = overwrite
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "1970-01-01T00:00:00Z")
        self.roll = int(options.get("rollbytes", ROLL_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                payload = row["payload"] or b""
                digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
                data = member(record(row["record_id"], row["record_type"], row["target_uri"], payload, digest, row["refers_to"], self.date))
                out.write(data)
                size += len(data)
                if size >= self.roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        old = manifests(store, folder) if self.overwrite else []
        names = sorted(f for m in messages if m is not None for f in m.files)
        with store.open_output_stream(f"{folder}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(names).encode())
        for manifest in old:
            gone = listed(store, manifest)
            store.delete_file(manifest)
            for name in gone:
                store.delete_file(f"{folder}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = store_of(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{folder}/{name}")


def manifests(store: pafs.FileSystem, folder: str) -> list[str]:
    infos = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(i.path for i in infos if i.base_name.startswith(MANIFEST))


def listed(store: pafs.FileSystem, manifest: str) -> list[str]:
    with store.open_input_stream(manifest, compression=None) as file:
        return json.loads(file.read())


@dataclass
class ArchiveFile(InputPartition):
    path: str


def parse_head(data: bytes) -> dict[str, str]:
    fields = {}
    for line in data.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().lower().decode()] = value.strip().decode(errors="replace")
    return fields


def heads(fields: dict[str, str]) -> dict[str, str | None]:
    digest = fields.get("warc-payload-digest")
    return {
        "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"),
        "payload_digest": digest.removeprefix("sha1:") if digest else None, "refers_to": fields.get("warc-refers-to"),
    }


class _Plain:
    """Records of an archive without usable member lengths, one after another, read in pieces."""

    def __init__(self, stream: pa.NativeFile):
        self.stream, self.buffer, self.inside = stream, b"", False
        start = stream.read(2)
        self.unzip = zlib.decompressobj(31) if start == b"\x1f\x8b" else None
        self._feed(start)

    def _feed(self, raw: bytes) -> None:
        while raw and self.unzip:
            self.buffer += self.unzip.decompress(raw)
            raw, self.inside = self.unzip.unused_data, not self.unzip.eof
            if self.unzip.eof:
                self.unzip = zlib.decompressobj(31)
        self.buffer += raw

    def _more(self) -> bool:
        raw = self.stream.read(1 << 20)
        if not raw and self.inside:
            raise ValueError("archive ends within a member")
        self._feed(raw)
        return bool(raw)

    def head(self) -> bytes | None:
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("archive ends within a record's head")
                return None
        found, self.buffer = self.buffer[:end], self.buffer[end + 4 :]
        return found.lstrip(b"\r\n")

    def block(self, size: int, wanted: bool) -> bytes:
        parts, left = [], size
        while left:
            if not self.buffer and not self._more():
                raise ValueError("archive ends within a record")
            part, self.buffer = self.buffer[:left], self.buffer[left:]
            left -= len(part)
            if wanted:
                parts.append(part)
        while len(self.buffer) < 4 and self._more():
            pass
        self.buffer = self.buffer[4:]
        return b"".join(parts)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"].rstrip("/"), options.get("payload", "true") != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, "known", None))
            else:
                yield f

    def wanted(self, head: dict[str, str | None]) -> bool:
        for name, test, value in self.tests:
            own = head[name]
            if own is None or (test == "in" and own not in value) or (test == "starts" and not own.startswith(value)):
                return False
        return True

    def partitions(self) -> list[ArchiveFile]:
        store, folder = store_of(self.path)
        if store.get_file_info(folder).type == pafs.FileType.File:
            return [ArchiveFile(folder)]
        own = [f"{folder}/{name}" for manifest in manifests(store, folder) for name in listed(store, manifest)]
        infos = store.get_file_info(pafs.FileSelector(folder, recursive=True))
        others = sorted(i.path for i in infos if i.path.endswith((".warc", ".warc.gz")) and not OWN.fullmatch(i.base_name))
        return [ArchiveFile(name) for name in own + others]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = store_of(self.path)
        rows, size = [], 0
        with store.open_input_file(partition.path) as file:
            for row in self.records(file, partition.path):
                rows.append(row)
                size += len(row["payload"] or b"") + 200
                if size >= 4 << 20 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def records(self, file: pa.NativeFile, name: str = "archive") -> Iterator[dict]:
        at, end = 0, file.size()
        while at < end:
            file.seek(at)
            start = file.read(HEAD)
            try:
                if start[:4] != b"\x1f\x8b\x08\x04" or start[12:14] != b"sl" or start[16:20] == b"\xff" * 4:
                    file.seek(at)
                    yield from self.plain(_Plain(file))
                    return
                length = int.from_bytes(start[16:20], "little")
                if length < 32 or at + length > end:
                    raise ValueError(f"a member of {length} bytes, {end - at} left")
                row = self.member(file, start, at, length)
            except (ValueError, KeyError, zlib.error) as why:
                raise ValueError(f"{name}, member at {at}: {why}") from why
            if row is not None:
                yield row
            at += length

    def member(self, file: pa.NativeFile, start: bytes, at: int, length: int) -> dict | None:
        """The record of a member whose first bytes are ``start``, or None if it is turned down by its head."""
        unzip = zlib.decompressobj(-15)
        data = unzip.decompress(start[24:length], HEAD)
        while (cut := data.find(b"\r\n\r\n")) < 0:  # a head longer than usual
            packed = unzip.unconsumed_tail or file.read(min(HEAD, at + length - file.tell()))
            if not packed or unzip.eof:
                raise ValueError("it ends within the record's head")
            data += unzip.decompress(packed, HEAD)
        fields = parse_head(data[:cut])
        head = heads(fields)
        if not self.wanted(head):
            return None
        block = None
        if self.payload and head["record_type"] != "revisit":
            rest = unzip.unconsumed_tail + (file.read(at + length - file.tell()) if file.tell() < at + length else b"")
            data += unzip.decompress(rest)
            tail = unzip.unused_data[:8]
            if not unzip.eof or tail[:4] != zlib.crc32(data).to_bytes(4, "little"):
                raise ValueError("its end is missing or its checksum does not hold")
            block = data[cut + 4 :][: int(fields["content-length"])]
            if len(block) < int(fields["content-length"]):
                raise ValueError("its block is shorter than its head says")
        return self.row(head, fields, block)

    def plain(self, source: _Plain) -> Iterator[dict]:
        while (raw := source.head()) is not None:
            fields = parse_head(raw)
            head = heads(fields)
            take = self.wanted(head)
            with_block = take and self.payload and head["record_type"] != "revisit"
            block = source.block(int(fields.get("content-length", 0)), with_block)
            if take:
                yield self.row(head, fields, block if with_block else None)

    def row(self, head: dict, fields: dict[str, str], block: bytes | None) -> dict:
        payload = None
        if block is not None:
            http = fields.get("content-type", "").startswith("application/http")
            payload = block.partition(b"\r\n\r\n")[2] if http else block
            if (told := head["payload_digest"]) and base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode() != told:
                raise ValueError(f"payload of {head['record_id']} does not match its digest")
        size = len(payload) if payload is not None else fields.get("x-payload-bytes")
        return head | {"payload_bytes": None if size is None else int(size), "payload": payload}


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Records for the writer: of pages with equal payloads the one with the largest id is the response, others revisit it.

    Payloads below ``min_bytes`` are all responses; so are rows that repeat the
    response's id, and a page without id whose payload no page with an id has.
    The largest id of a digest is found from narrow rows, combined before the
    shuffle; a digest that many pages share is a skewed join key, which
    adaptive execution splits.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("target_uri"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    last = rows.groupBy("digest").agg(F.max("page").alias("kept")).filter("kept is not null").withColumnRenamed("digest", "of")
    joined = rows.join(last, F.col("digest") == F.col("of"), "left")
    again = F.col("kept").isNotNull() & ~F.col("page").eqNullSafe(F.col("kept")) & (F.octet_length("payload") >= min_bytes)
    name = lambda c: F.concat(F.lit("<urn:x-page:"), c.cast("string"), F.lit(">"))
    return joined.select(
        name(F.col("page")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri", "payload",
        F.when(again, name(F.col("kept"))).alias("refers_to"),
    )


def write_archive(records: DataFrame, path: str, mode: str = "append") -> None:
    """Write ``records`` beside (``append``) or in place of (``overwrite``) what was written to ``path`` before."""
    register(records.sparkSession)
    records.write.format("warc").mode(mode).save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
