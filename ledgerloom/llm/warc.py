"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans files into partitions of about ``partition_bytes``.  Predicates
on the record type and the other header columns are pushed into the scan: a
record's WARC header and the head of its HTTP block are parsed first, and the
payload of a record that no predicate wants is never decoded.  Plain files are
skipped by seeking.  In ``.gz`` files (one member per record) only the first
bytes of a member are inflated; the member's ``sl`` extra field tells how far
to seek.  Members without that field, as other tools write them, are inflated
to find their end.  ``payload=false`` skips all payloads.

Writing makes one file per task (more beyond ``file_bytes``), first under
``_pending``; the files named by the tasks that succeeded are moved into place
at commit, so lost executors and repeated attempts leave no double records.

Folders are reached through ``pyarrow.fs`` (local and shared folders, HDFS,
S3, GCS); they need not be mounted.

Defined cases: a null payload is an empty one; null header values are not
written and read back as null; control characters and spaces in a URI are
percent-encoded.  A truncated or malformed record ends the read with an error
that names file and offset.  Empty tables write no record, an empty folder has
no rows.
"""

from __future__ import annotations

import base64
import io
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
    In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
    WriterCommitMessage,
)

MIN_REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, "
    "content_type string, content_length long, payload_length long, headers map<string,string>, payload binary, "
    "file string, offset long"
)
WRITE_COLUMNS = ("record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to", "payload_length", "payload")

#: Columns known before the payload is decoded, with the header they come from.
HEADER_COLUMNS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type",
}
NUMBER_COLUMNS = ("content_length", "payload_length", "offset")

_ARROW = pa.schema([
    *[(c, pa.string()) for c in HEADER_COLUMNS], ("content_length", pa.int64()), ("payload_length", pa.int64()),
    ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()),
])
_BATCH_BYTES = 4_000_000
_HEAD = 1 << 16


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


# --- predicates -------------------------------------------------------------

_COMPARE: dict[type, Callable[[object, object], bool]] = {
    EqualTo: lambda a, b: a == b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    StringStartsWith: lambda a, b: a.startswith(b),
    StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
    In: lambda a, b: a in b,
}


def predicate(wanted: Filter) -> Callable[[dict], bool | None] | None:
    """The filter as a function of a record's header columns (null: unknown); None if it needs more than headers."""
    if isinstance(wanted, Not):
        inner = predicate(wanted.child)
        if inner is None:
            return None
        return lambda record: None if (value := inner(record)) is None else not value
    column = getattr(wanted, "attribute", ())
    if len(column) != 1 or column[0] not in (*HEADER_COLUMNS, *NUMBER_COLUMNS):
        return None
    name = column[0]
    if isinstance(wanted, IsNull):
        return lambda record: record[name] is None
    if isinstance(wanted, IsNotNull):
        return lambda record: record[name] is not None
    value = wanted.value
    if isinstance(wanted, EqualNullSafe):
        return lambda record: record[name] == value
    compare = _COMPARE.get(type(wanted))
    if compare is None or value is None or (isinstance(wanted, In) and None in value):
        return None
    return lambda record: None if record[name] is None else compare(record[name], value)


# --- reading ----------------------------------------------------------------


@dataclass
class FileGroup(InputPartition):
    paths: list[str]


def planned(files: list[tuple[str, int]], partition_bytes: int) -> list[FileGroup]:
    """Whole files in name order, packed into groups of about ``partition_bytes``."""
    groups: list[list[str]] = []
    room = 0
    for path, size in sorted(files):
        if not groups or size > room:
            groups.append([])
            room = partition_bytes
        groups[-1].append(path)
        room -= size
    return [FileGroup(paths) for paths in groups]


def header_fields(lines: list[bytes]) -> dict[str, str]:
    """Header lines as a map with lower-case names; a folded line continues the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in b" \t" and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, _, value = line.partition(b":")
        name = key.strip().decode("utf-8", "replace").lower()
        out[name] = value.strip().decode("utf-8", "replace")
    return out


class Record:
    """A record whose head is parsed; ``block`` decodes the rest when asked."""

    def __init__(self, head: bytes, block_head: bytes, file: str, offset: int):
        first, *lines = head.rstrip(b"\r\n").split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"{file}: no WARC record at {offset}")
        self.fields = header_fields(lines)
        if not self.fields.get("content-length", "").isdigit():
            raise ValueError(f"{file}: record at {offset} has no length")
        length = int(self.fields["content-length"])
        self.is_http = self.fields.get("content-type", "").replace(" ", "").startswith("application/http")
        payload_length: int | None = length
        if self.is_http:
            http, end, _ = block_head.partition(b"\r\n\r\n")
            stated = header_fields(http.split(b"\r\n")[1:]).get("content-length", "") if end else ""
            payload_length = int(stated) if stated.isdigit() else (length - len(http) - 4 if end else None)
        self.columns = {c: self.fields.get(h) for c, h in HEADER_COLUMNS.items()}
        self.columns |= {"content_length": length, "payload_length": payload_length, "offset": offset, "file": file}

    def payload(self, block: bytes) -> bytes:
        if not self.is_http:
            return block
        _, end, rest = block.partition(b"\r\n\r\n")
        return rest if end else b""


def records(stream: io.BufferedReader, file: str, wanted: Callable[[Record], bool], payload: bool) -> Iterator[tuple[Record, bytes | None]]:
    """The wanted records of a file, plain or gzip, with their payload if asked for."""
    while True:
        offset = stream.tell()
        start = stream.peek(2)[:2]
        if not start:
            return
        if start == b"\r\n":  # blank lines between records
            stream.read(2)
            continue
        step = _member if start == b"\x1f\x8b" else _plain
        record, block = step(stream, file, offset, wanted, payload)
        if record is not None:
            yield record, block


def _plain(stream, file, offset, wanted, payload):
    lines = []
    while (line := stream.readline(_HEAD)) not in (b"\r\n", b""):
        lines.append(line)
    if line == b"":
        raise ValueError(f"{file}: record at {offset} is cut short")
    head = b"".join(lines)
    at = stream.tell()
    length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    peeked = stream.read(min(_HEAD, int(length.group(1)))) if length else b""
    record = Record(head, peeked, file, offset)
    size = record.columns["content_length"]
    keep = wanted(record)
    block = None
    if keep and payload:
        block = peeked + stream.read(size - len(peeked))
        if len(block) < size:
            raise ValueError(f"{file}: record at {offset} is cut short")
    stream.seek(at + size + 4)
    return (record, record.payload(block) if block is not None else None) if keep else (None, None)


def _member(stream, file, offset, wanted, payload):
    fixed = stream.read(10)
    if len(fixed) < 10 or fixed[2] != 8:
        raise ValueError(f"{file}: no gzip member at {offset}")
    flags, size, known = fixed[3], 10, 0
    if flags & 4:
        (extra,) = struct.unpack("<H", stream.read(2))
        fields = stream.read(extra)
        size += 2 + extra
        while len(fields) >= 4:
            (n,) = struct.unpack("<H", fields[2:4])
            if fields[:2] == b"sl" and n == 8:
                (known,) = struct.unpack("<I", fields[4:8])
            fields = fields[4 + n :]
    for flag in (8, 16):  # a file name, a comment
        if flags & flag:
            while stream.read(1) not in (b"\x00", b""):
                pass
    if flags & 2:
        stream.read(2)
    inflate = zlib.decompressobj(-15)
    text = b""
    # enough for the header and the head of the block
    while not inflate.eof and (text.count(b"\r\n\r\n") < 2 and len(text) < _HEAD):
        some = inflate.unconsumed_tail or stream.read(4096)
        if not some:
            raise ValueError(f"{file}: record at {offset} is cut short")
        text += inflate.decompress(some, 4096)
    head, end, block_head = text.partition(b"\r\n\r\n")
    if not end:
        raise ValueError(f"{file}: record at {offset} has no end of header")
    record = Record(head, block_head, file, offset)
    keep = wanted(record)
    if known and not (keep and payload):
        stream.seek(offset + known)
        return (record, None) if keep else (None, None)
    parts = [block_head]
    while not inflate.eof:
        some = inflate.unconsumed_tail or stream.read(1 << 16)
        if not some:
            raise ValueError(f"{file}: record at {offset} is cut short")
        part = inflate.decompress(some, 1 << 20)
        if keep and payload:
            parts.append(part)
    stream.seek(stream.tell() - len(inflate.unused_data))
    stream.read(8)  # checksum and length
    if not keep:
        return None, None
    if not payload:
        return record, None
    size = record.columns["content_length"]
    block = b"".join(parts)
    if len(block) < size:
        raise ValueError(f"{file}: record at {offset} is cut short")
    return record, record.payload(block[:size])


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        for wanted in filters:
            if predicate(wanted) is None:
                yield wanted
            else:
                self.filters.append(wanted)

    def partitions(self):
        filesystem, root = opened(self.path)
        found = filesystem.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = re.compile(r"/[_.]")
        files = [(f.path, f.size) for f in found if f.type == pafs.FileType.File and not hidden.search(f.path[len(root):])]
        return planned(files, self.partition_bytes) or [FileGroup([])]

    def read(self, partition):
        filesystem, _ = opened(self.path)
        tests = [predicate(f) for f in self.filters]

        def wanted(record: Record) -> bool:
            return all(test(record.columns) for test in tests)

        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with io.BufferedReader(filesystem.open_input_file(path), 1 << 20) as stream:
                for record, payload in records(stream, path, wanted, self.payload):
                    rows.append(record.columns | {"headers": list(record.fields.items()), "payload": payload})
                    size += len(payload or b"") + 1000
                    if size > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


# --- writing ----------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def clean(value: str) -> str:
    """A header value on one line: control characters and spaces percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def encoded(row: dict) -> bytes:
    """One record in WARC/1.1.  A revisit has the HTTP head of its payload, but no payload."""
    payload = row["payload"] or b""
    stated = row["payload_length"] if row["payload_length"] is not None else len(payload)
    revisit = row["record_type"] == "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % stated
    if not revisit:
        block += payload
    digest = row["payload_digest"]
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"] or DATE),
        ("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Payload-Digest", digest and "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    lines = "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None)
    lines += f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n"
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int) -> bytes:
    """The record as one gzip member with its lengths in the ``sl`` extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    fits = max(size, len(record)) < 1 << 32  # longer ones state no length; readers then inflate them to their end
    lengths = struct.pack("<II", size, len(record)) if fits else bytes(8)
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8) + lengths
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.overwrite = overwrite
        self.gzip = str(options.get("gzip", "true")).lower() == "true"
        self.level = int(options.get("level", 2))
        self.file_bytes = int(options.get("file_bytes", 256 << 20))
        self.attempts = uuid.uuid4().hex

    def write(self, iterator):
        filesystem, root = opened(self.path)
        pending = f"{root}/_pending-{self.attempts}"
        filesystem.create_dir(pending, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 64):  # few payloads as Python objects at a time
                for row in batch.slice(at, 64).select(list(WRITE_COLUMNS)).to_pylist():
                    record = encoded(row)
                    data = member(record, self.level) if self.gzip else record
                    if out is None or size + len(data) > self.file_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.gzip else ""))
                        out, size = filesystem.open_output_stream(f"{pending}/{names[-1]}", compression=None, buffer_size=1 << 20), 0
                    out.write(data)
                    size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        filesystem, root = opened(self.path)
        filesystem.create_dir(root, recursive=True)
        if self.overwrite:
            for info in filesystem.get_file_info(pafs.FileSelector(root)):
                if info.type == pafs.FileType.File:
                    filesystem.delete_file(info.path)
        for message in messages:
            for name in message.files if message else []:
                filesystem.move(f"{root}/_pending-{self.attempts}/{name}", f"{root}/{name}")
        self._clear(filesystem, root)

    def abort(self, messages):
        self._clear(*opened(self.path))

    def _clear(self, filesystem, root):
        pending = f"{root}/_pending-{self.attempts}"
        if filesystem.get_file_info(pending).type == pafs.FileType.Directory:
            filesystem.delete_dir(pending)


class WarcSource(DataSource):
    """``format("warc")``; options ``path, payload, partition_bytes`` and ``gzip, level, file_bytes``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


# --- archives of pages ------------------------------------------------------


def registered(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under ``path``; filters on header columns reach the scan."""
    registered(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def with_revisits(pages: DataFrame, least_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The records to write for ``page_id, url, html``: the largest id of equal payloads is the response, others revisit it.

    Payloads below ``least_bytes`` are all responses.  Equal means equal in
    SHA-256.  Rows that repeat the largest id are all responses, a null id
    revisits any other.  Ids meet per payload as one maximum, so a payload that
    a third of all rows share is one row on that side of the join, and adaptive
    execution splits the other.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), html.alias("payload"))
    rows = rows.withColumn("payload_length", F.octet_length("payload").cast("long"))
    long = F.col("payload_length") >= least_bytes
    slim = rows.where(long & F.col("page_id").isNotNull()).select(F.sha2("payload", 256).alias("equal"), "page_id")
    keepers = slim.groupBy("equal").agg(F.max("page_id").alias("keeper"))
    # short payloads meet nothing; their keys only spread them
    spread = F.concat(F.lit("-"), F.xxhash64("page_id", "target_uri").cast("string"))
    joined = rows.withColumn("equal", F.when(long, F.sha2("payload", 256)).otherwise(spread)).join(keepers, "equal", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))

    def urn(column: str):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))

    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), "target_uri",
        F.lit(DATE).alias("date"), F.sha1("payload").alias("payload_digest"), F.when(revisit, urn("keeper")).alias("refers_to"),
        "payload_length", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archive(pages: DataFrame, path: str, least_bytes: int = MIN_REVISIT_BYTES, **options: object) -> None:
    """Writes the pages as WARC records under ``path``; ``options`` are the writer's."""
    registered(pages.sparkSession)
    records_ = with_revisits(pages, least_bytes)
    writer = records_.write.format("warc").mode("append")
    for name, value in options.items():
        writer = writer.option(name, str(value).lower() if isinstance(value, bool) else value)
    writer.save(path)


def page_of(column: str):
    """The page id that a record id holds; null if it holds none."""
    digits = F.regexp_extract(F.col(column), "^<urn:page:(-?[0-9]+)>$", 1)
    return F.when(digits != "", digits).cast("long")


def round_trip(pages: DataFrame, path: str, least_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes the pages, reads them back: one row per record.

    Digest and length of a response are those of the payload read; a revisit
    is known by its headers, so its scan decodes no payload.
    """
    spark = pages.sparkSession
    write_archive(pages, path, least_bytes)
    whole = read_archive(spark, path).where("record_type = 'response'").select(
        page_of("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    digest = hex_of("payload_digest")
    heads = read_archive(spark, path, payload=False).where("record_type = 'revisit'").select(
        page_of("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), digest.alias("payload_digest"),
        "record_type", page_of("refers_to").alias("refers_to"),
    )
    return whole.unionByName(heads)


def hex_of(column: str):
    """The digest behind ``sha1:``, 32 base-32 digits, as 40 lower-case hexadecimal ones."""
    digits = F.translate(F.substring(F.col(column), 6, 32), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuv")
    groups = [F.lpad(F.conv(F.substring(digits, 8 * i + 1, 8), 32, 16), 10, "0") for i in range(4)]
    return F.lower(F.concat(*groups))
