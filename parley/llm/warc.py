"""WARC as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

*Writing*: each task writes its records, one gzip member each, to files of its
own; the driver's commit writes a manifest that names the files of successful
tasks, so what a lost executor or a second attempt left behind is never read.
Members carry the ``sl`` extra field (their lengths), which lets a reader jump
over a record without inflating it.

*Reading*: partitions are runs of files of about ``partitionBytes``.  Header
predicates (record type, URI, digest, ...) are pushed down; a record's headers
are parsed first, and its payload is inflated only if the record passes and the
schema asks for ``payload``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from parley.plans.stages import materialize
from parley.session import scratch_path

#: Column of a header: (named field of the record, whether it stands in <>).
HEADERS = {
    "record_id": ("WARC-Record-ID", True),
    "record_type": ("WARC-Type", False),
    "target_uri": ("WARC-Target-URI", False),
    "warc_date": ("WARC-Date", False),
    "refers_to": ("WARC-Refers-To", True),
    "payload_digest": ("WARC-Payload-Digest", False),
    "payload_length": ("X-Payload-Length", False),
}
SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, refers_to string, "
          "payload_digest string, payload_length long, payload binary")
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = "1970-01-01T00:00:00Z"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing -----------------------------------------------------------------

def _clean(value: object) -> str:
    """A header value on one line."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def encode_record(row: dict) -> bytes:
    """One WARC/1.1 record, uncompressed.  A revisit carries HTTP headers but no body.

    ``payload_sha1`` (20 bytes) may stand in for ``payload_digest``.
    """
    body = row.get("payload") or b""
    kind = row.get("record_type") or "response"
    block = _HTTP.replace("%d", str(row.get("payload_length") or len(body))).encode()
    if kind != "revisit":
        block += body
    lines = ["WARC/1.1"]
    for column, (field, angled) in HEADERS.items():
        value = row.get(column)
        if column == "warc_date":
            value = value or _EPOCH
        elif column == "record_type":
            value = kind
        elif column == "payload_digest" and row.get("payload_sha1") is not None:
            value = "sha1:" + base64.b32encode(row["payload_sha1"]).decode()
        if value is not None:
            lines.append(f"{field}: <{_clean(value)}>" if angled else f"{field}: {_clean(value)}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {_IDENTICAL}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 6) -> bytes:
    """A gzip member whose ``sl`` extra field holds its own and the inflated length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = deflate.compress(record) + deflate.flush()
    total = 10 + 14 + len(packed) + 8
    if max(total, len(record)) < 1 << 32:
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(record))
    else:
        head = b"\x1f\x8b\x08\x00" + bytes(4) + b"\x00\xff"
    return head + packed + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, file_bytes: int, level: int):
        self.path, self.overwrite, self.file_bytes, self.level = path, overwrite, file_bytes, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        out, files = None, []
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                member = gzip_member(encode_record(row), self.level)
                if out is None or files[-1][1] >= self.file_bytes:
                    if out is not None:
                        out.close()
                    files.append([f"part-{uuid.uuid4().hex}.warc.gz", 0])
                    out = fs.open_output_stream(f"{root}/{files[-1][0]}", compression=None)
                out.write(member)
                files[-1][1] += len(member)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        old = [x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.startswith("_manifest-")]
        files = [f for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(files).encode())
        if self.overwrite:
            for path in old:
                fs.delete_file(path)

    def abort(self, messages) -> None:
        fs, root = _open(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                fs.delete_file(f"{root}/{name}")


# --- reading -----------------------------------------------------------------

class _Window:
    """Random access to a file through reads of a megabyte or more."""

    def __init__(self, file, step: int = 1 << 20):
        self.file, self.size, self.step = file, file.size(), step
        self.at, self.held = 0, b""

    def get(self, start: int, n: int) -> bytes:
        if start < self.at or start + n > self.at + len(self.held):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(max(n, self.step))
        return self.held[start - self.at: start - self.at + n]


def _parse_headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _records(window: _Window, wants: callable, payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """(headers, block or None) of the records that ``wants`` their headers."""
    at = 0
    while at < window.size:
        first = window.get(at, 24)
        if first[:2] != b"\x1f\x8b":   # not compressed
            span = 4096
            while (end := (held := window.get(at, span)).find(b"\r\n\r\n")) < 0 and at + span < window.size:
                span *= 2
            if end < 0:
                raise ValueError(f"no end of headers in the record at byte {at}")
            headers = _parse_headers(held[:end])
            length = int(headers["content-length"])
            if wants(headers):
                yield headers, window.get(at + end + 4, length) if payload else None
            at += end + 4 + length + 4
            continue
        total = None
        if first[3] & 4 and first[12:14] == b"sl":
            total = struct.unpack("<I", first[16:20])[0]
        inflate, pos = zlib.decompressobj(31), at
        plain = b""
        while (end := plain.find(b"\r\n\r\n")) < 0 and not inflate.eof:   # as far as the headers only
            chunk = inflate.unconsumed_tail or window.get(pos, min(1024, window.size - pos))
            if not inflate.unconsumed_tail:
                pos += len(chunk)
            if not chunk:
                raise ValueError(f"the record at byte {at} is cut off")
            plain += inflate.decompress(chunk, 2048)
        headers = _parse_headers(plain[:max(end, 0)])
        wanted = wants(headers)
        if total is None or (wanted and payload):
            parts = [plain]
            while not inflate.eof:
                chunk = inflate.unconsumed_tail or window.get(pos, min(1 << 16, window.size - pos))
                if not inflate.unconsumed_tail:
                    pos += len(chunk)
                if not chunk:
                    raise ValueError(f"the record at byte {at} is cut off")
                parts.append(inflate.decompress(chunk, 1 << 20))
            plain = b"".join(parts)
            total = pos - at - len(inflate.unused_data)
        if wanted:
            yield headers, plain[end + 4: end + 4 + int(headers["content-length"])] if payload else None
        at += total


def _value(headers: dict, column: str):
    field, angled = HEADERS[column]
    value = headers.get(field.lower())
    if value is None:
        return None
    if column == "payload_length":
        return int(value)
    if column == "payload_digest":
        return value.removeprefix("sha1:")
    return value[1:-1] if angled and value[:1] == "<" and value[-1:] == ">" else value


def _passes(condition, headers: dict) -> bool:
    value = _value(headers, condition.attribute[0])
    if isinstance(condition, IsNotNull):
        return value is not None
    if value is None:
        return isinstance(condition, EqualNullSafe) and condition.value is None
    if isinstance(condition, (EqualTo, EqualNullSafe)):
        return value == condition.value
    if isinstance(condition, In):
        return value in condition.value
    test = {StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}
    return test[type(condition)](value, condition.value)


PUSHABLE = (EqualTo, EqualNullSafe, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)


@dataclass
class FileRun(InputPartition):
    files: list


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema, partition_bytes: int):
        self.path, self.columns, self.partition_bytes = path, schema.names, partition_bytes
        self.arrow = None
        self.conditions = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, PUSHABLE) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.conditions.append(f)
            else:
                yield f

    def partitions(self):
        fs, root = _open(self.path)
        listed = fs.get_file_info(pafs.FileSelector(root, allow_not_found=False))
        manifests = [x.path for x in listed if x.base_name.startswith("_manifest-")]
        if manifests:
            files = []
            for path in manifests:
                with fs.open_input_stream(path) as f:
                    files += json.loads(f.read())
        else:
            files = [[x.base_name, x.size] for x in listed if x.base_name.endswith((".warc", ".warc.gz"))]
        runs, held = [[]], 0
        for name, size in sorted(files):
            if runs[-1] and held + size > self.partition_bytes:
                runs.append([])
                held = 0
            runs[-1].append(name)
            held += size
        return [FileRun(r) for r in runs if r]

    def read(self, partition):
        kinds = {"payload": pa.binary(), "payload_length": pa.int64()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        payload = "payload" in self.columns
        wants = lambda headers: all(_passes(c, headers) for c in self.conditions)
        if partition is None:   # an archive without files
            return
        fs, root = _open(self.path)
        rows, held = [], 0
        for name in partition.files:
            with fs.open_input_file(f"{root}/{name}") as file:
                for headers, block in _records(_Window(file), wants, payload):
                    row = {c: _value(headers, c) for c in self.columns if c != "payload"}
                    if payload:
                        row["payload"] = self._payload(headers, block)
                        held += len(block)
                    rows.append(row)
                    if len(rows) >= 4096 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    @staticmethod
    def _payload(headers: dict, block: bytes) -> bytes | None:
        """The payload of a record, checked against its digest; null for a revisit."""
        if headers.get("warc-type") == "revisit":
            return None
        if headers.get("content-type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if digest and digest != base32_sha1(block):
            raise ValueError(f"payload of {headers.get('warc-record-id')} does not match its digest")
        return block


class WarcDataSource(DataSource):
    """Options: path; ``partitionBytes`` (64 MB) for reads; ``fileBytes`` (256 MB) and ``level`` (6) for writes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema, int(self.options.get("partitionBytes", 64 << 20)))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("fileBytes", 256 << 20)),
                          int(self.options.get("level", 6)))


def register_warc(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to the session and let filters reach Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# --- pages ---------------------------------------------------------------------

def page_records(pages: DataFrame, *, min_bytes: int = 0, id_col: str = "page_id",
                 url_col: str = "url", html_col: str = "html") -> DataFrame:
    """WARC records of pages: one response for each distinct payload, revisits for the rest.

    Among payloads of at least ``min_bytes`` that are equal, the row with the
    largest id is the response; smaller ones are all responses.  A null html is an
    empty payload, a null id is the smallest and has the record id ``urn:page:``;
    rows that repeat the response's id are responses too.  Only (digest, id) is
    aggregated, with a map-side combine; digests that occur once take no part in
    the join, whose page side Spark can split where one digest is very frequent.
    """
    body = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("target_uri"), body.alias("body"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("body"))).withColumn("payload_length", F.octet_length("body").cast("long"))
    shared = (rows.where(F.col("payload_length") >= min_bytes).groupBy("sha")
              .agg(F.max("page").alias("keeper"), F.count("*").alias("n"))
              .where("n > 1").select(F.col("sha").alias("shared_sha"), "keeper"))
    shared = materialize(shared, "warc-shared")
    joined = rows.join(shared, rows.sha == shared.shared_sha, "left")
    again = F.col("shared_sha").isNotNull() & ~F.col("page").eqNullSafe(F.col("keeper"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return joined.select(
        name("page").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.when(again, name("keeper")).alias("refers_to"),
        F.col("sha").alias("payload_sha1"), "payload_length",
        F.when(~again, F.col("body")).alias("payload"))


def archive_pages(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write ``pages`` as WARC archives under ``path`` and read all records back.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to of
    every record, as found in the archives: of a response from its payload, of a
    revisit from its headers.  An empty table gives an empty archive and result.
    """
    spark = pages.sparkSession
    register_warc(spark)
    kind = pages.schema[columns.get("id_col", "page_id")].dataType.simpleString()
    path = path or scratch_path(spark, "warc")
    page_records(pages, **columns).write.format("warc").mode("append").option("level", 4).save(path)
    read = spark.read.format("warc").load(path)
    number = lambda c: F.nullif(F.substring(c, len("urn:page:") + 1, 1 << 20), F.lit("")).cast(kind)
    return read.select(
        number("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        "payload_digest", "record_type", number("refers_to").alias("refers_to"))
