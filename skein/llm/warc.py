"""WARC archives as a PySpark Python data source, with writer and reader.

Records are gzip members of their own; a field in the gzip head holds the member's length. Reading plans one partition per
file or byte range of members, takes record-type and header predicates, parses headers first and passes over the payload
of records that the predicates or the asked columns don't want: by a seek where the length is known (archives written
here), else by inflating it without decoding. Spark tells a Python source its filters but not its projection, so columns
are chosen by ``read_archive(..., columns=...)``. Records of other writers are read by header names in any case; their
payload is the record's block. Uncompressed archives are refused. Files are opened with ``pyarrow.fs``, so any store that
it knows will do.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

from skein.llm.common import new_folder

SCHEMA = "warc_type string, record_id string, target_uri string, warc_date string, payload_digest string, payload_length long, refers_to string, content_type string, payload binary"
HEADERS = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
}
MIN_REVISIT_BYTES = 1000
_GZIP = b"\x1f\x8b\x08"
_LENGTH = b"SL"  # the field of the gzip head that holds the member's length
_EPOCH = "1970-01-01T00:00:00Z"


def open_store(path: str):
    """File system and path in it. A bare path is local."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def encode_record(row: dict) -> bytes:
    """One record as a gzip member. Line breaks can't enter a header: they become spaces."""
    body = bytes(row["payload"] or b"")
    lines = ["WARC/1.1"]
    for name, header in HEADERS.items():
        if row.get(name) is not None:
            lines.append(f"{header}: " + " ".join(str(row[name]).split("\r")).replace("\n", " "))
    lines.append(f"Content-Length: {len(body)}")
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    c = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = c.compress(raw) + c.flush()
    extra = _LENGTH + struct.pack("<HQ", 8, 10 + 2 + 12 + len(packed) + 8)
    head = _GZIP + b"\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra
    return head + packed + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    path: str
    records: int


class WarcWriter(DataSourceWriter):
    """One file per task, under a name of its own; files of failed attempts are removed, and only committed ones are listed."""

    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.names = options["path"], names

    def write(self, iterator) -> Written:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        n = 0
        with store.open_output_stream(f"{root}/_{name}", compression=None) as out, io.BufferedWriter(_Raw(out), 1 << 20) as f:
            for row in iterator:
                f.write(encode_record(row.asDict()))
                n += 1
        return Written(name, n)

    def commit(self, messages) -> None:
        store, root = open_store(self.path)
        for m in messages:
            if m is not None:
                store.move(f"{root}/_{m.path}", f"{root}/{m.path}")

    def abort(self, messages) -> None:
        store, root = open_store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/_{m.path}")


class _Raw(io.RawIOBase):
    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        return len(data)


@dataclass
class Span(InputPartition):
    path: str
    start: int
    end: int


class Members:
    """Gzip members that begin in a byte range of a file, inflated as far as asked."""

    def __init__(self, f, start: int, end: int, chunk: int = 1 << 18):
        self.f, self.end, self.chunk = f, end, chunk
        self.base, self.buf, self.pos = start, b"", 0
        f.seek(start)

    def _more(self) -> bool:
        data = self.f.read(self.chunk)
        if not data:
            return False
        self.base += self.pos
        self.buf, self.pos = self.buf[self.pos :] + data, 0
        return True

    def go(self, to: int) -> None:
        if self.base <= to <= self.base + len(self.buf):
            self.pos = to - self.base
        else:
            self.f.seek(to)
            self.base, self.buf, self.pos = to, b"", 0

    def seek_first(self) -> None:
        """To the first member at or after the start: a gzip head whose content starts with WARC/."""
        while True:
            k = self.buf.find(_GZIP, self.pos)
            if k < 0:
                self.pos = max(self.pos, len(self.buf) - len(_GZIP) + 1)
                if not self._more():
                    self.pos = len(self.buf)
                    return
                continue
            self.pos = k
            if len(self.buf) - k < 4096:
                self._more()
            try:
                if zlib.decompressobj(31).decompress(self.buf[self.pos : self.pos + 4096], 5) == b"WARC/":
                    return
            except zlib.error:
                pass
            self.pos += 1

    def __iter__(self) -> Iterator[Member]:
        while self.base + self.pos < self.end:
            if self.pos == len(self.buf) and not self._more():
                return
            m = Member(self)
            yield m
            m.finish()


class Member:
    def __init__(self, source: Members):
        self.s, self.z = source, zlib.decompressobj(31)
        self.head = b""
        self.end = self._known_end()

    def _known_end(self) -> int | None:
        """Where the member ends, if its head says so."""
        s = self.s
        if len(s.buf) - s.pos < 24:
            s._more()
        head = s.buf[s.pos : s.pos + 24]
        if len(head) == 24 and head[:4] == _GZIP + b"\x04" and head[10:16] == struct.pack("<H", 12) + _LENGTH + struct.pack("<H", 8):
            return s.base + s.pos + struct.unpack("<Q", head[16:])[0]
        return None

    def _inflate(self, limit: int) -> bytes:
        s = self.s
        if s.pos == len(s.buf) and not s._more():
            raise EOFError("a WARC record ends early")
        data = s.buf[s.pos : s.pos + 8192]
        out = self.z.decompress(data, limit)
        left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        s.pos += len(data) - len(left)
        return out

    def headers(self) -> dict[str, str]:
        while b"\r\n\r\n" not in self.head and not self.z.eof:
            self.head += self._inflate(1 << 12)
        head, _, self.head = self.head.partition(b"\r\n\r\n")
        lines = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
        return {name.strip().lower(): value.strip() for name, colon, value in lines if colon}

    def payload(self, n: int) -> bytes:
        parts, have = [self.head], len(self.head)
        while have < n and not self.z.eof:
            parts.append(self._inflate(1 << 18))
            have += len(parts[-1])
        self.head = b""
        return b"".join(parts)[:n]

    def finish(self) -> None:
        """Pass over the rest: by a seek, or inflated in small pieces that are dropped at once and never decoded."""
        if self.end is not None:
            self.s.go(self.end)
            return
        while not self.z.eof:
            self._inflate(1 << 18)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.names = options["path"], names
        self.split = int(options.get("splitbytes", 64 << 20))
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.wanted: dict[str, set] = {}
        if options.get("recordtypes"):
            self.wanted["warc_type"] = set(options["recordtypes"].split(","))

    def pushFilters(self, filters):
        """Equality and IN on header columns are taken; Spark keeps the rest."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name in HEADERS and name != "payload_length" and values is not None:
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Span]:
        from pyarrow import fs

        store, root = open_store(self.path)
        out = []
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.is_file and info.base_name.endswith(".warc"):
                raise ValueError(f"{info.path}: only archives with a gzip member per record are read")
            if info.is_file and info.base_name.endswith(".warc.gz") and not info.base_name.startswith("_"):
                out += [Span(info.path, a, min(info.size, a + self.split)) for a in range(0, info.size, self.split)]
        return out or [Span("", 0, 0)]

    def read(self, span: Span):
        if not span.path:
            return
        store, _ = open_store(self.path)
        with store.open_input_file(span.path) as f:
            members = Members(f, span.start, span.end)
            if span.start:
                members.seek_first()
            for m in members:
                h = m.headers()
                row = {c: h.get(k.lower()) for c, k in HEADERS.items()}
                if any(row[c] not in ok for c, ok in self.wanted.items()):
                    continue
                n = int(h.get("content-length", 0))
                row["payload_length"] = int(row["payload_length"] or n)
                row["payload"] = m.payload(n) if self.with_payload and "payload" in self.names else None
                yield tuple(row[c] for c in self.names)


class WarcDataSource(DataSource):
    """``format("warc")``. Options: ``path``; for reading ``recordTypes`` (comma separated), ``payload`` (false: headers
    only) and ``splitBytes``. A missing folder reads as empty. The target of a write must be new."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), schema.names)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """WARC rows of ``pages`` (page_id, url, html): of equal payloads the one with the largest page_id is a response and
    the others revisit it; payloads under ``min_revisit_bytes`` are all responses.

    Null html is an empty payload, an empty table gives no records, texts of any length are one record each, null urls have no target header, and rows that repeat a page_id with the same payload
    are all responses. Digests meet in an aggregate and return by a join that Spark can split, so a payload that holds a
    third of all pages is no task of its own.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.length("payload").cast("long"))
    heads = rows.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    both = rows.join(heads, "digest", "left")
    revisit = (F.col("head") > F.col("page_id")) & (F.col("n") >= min_revisit_bytes)
    rid = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return both.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        rid(F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(_EPOCH).alias("warc_date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.col("n").alias("payload_length"),
        F.when(revisit, rid(F.col("head"))).alias("refers_to"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"),
    )


def write_archive(records: DataFrame, path: str | None = None) -> str:
    """Write WARC rows below ``path`` (a new folder in the shared folder by default) and return it."""
    spark = records.sparkSession
    register(spark)
    path = path or new_folder(spark, "warc")
    records.write.format("warc").mode("append").save(path)
    return path


def read_archive(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """The records below ``path``. Of ``columns`` alone nothing else is built: without ``payload`` no payload is inflated."""
    register(spark)
    r = spark.read.format("warc")
    for k, v in options.items():
        r = r.option(k, v)
    if columns is not None:
        kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
        r = r.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return r.load(path)
