"""WARC archives as a Spark data source.

Writing: each task writes its records to files of its own, one gzip member per
record, and the commit names the files that count in a manifest of this job, so
that the files of a failed or repeated task are never read and a later append
keeps what stands there.  A member's extra field "sl" holds its compressed and
its full length.

Reading: files are planned into partitions, equality filters on the record type
and on header fields are pushed down, the headers of a record are inflated and
parsed first, and a record that no filter wants, or whose payload is not asked
for, is skipped by its length without inflating its block."""

from __future__ import annotations

import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage

from .common import importable

RECORD_SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_length long, payload binary"
#: Column of a record and the header field that holds it.
FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "WARC-Payload-Length",
}
#: Bytes that are inflated at a time while looking for the end of the headers, and of the first request to a file.
HEAD_BYTES = 2048
#: Requests to a file that is read on without gaps grow up to this.
AHEAD_BYTES = 1 << 20
#: A task begins a new file beyond this.
FILE_BYTES = 32_000_000
MANIFEST = "_manifest"
#: Header that names the coded fields of a record; fields of other writers are never decoded.
CODED = "X-Coded-Fields"
#: Marks of a URI that coding leaves alone (fixed value); a percent sign is coded.
SAFE_MARKS = ":/?#[]@!$&'()*+,;=<>"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def header_line(field: str, value: str) -> tuple[str, bool]:
    """The line of a field, and whether its value had to be coded.  A header value
    keeps to its line; only one that cannot (line ends, white space at its ends) is
    percent-coded, all others stand as they are."""
    if value == value.strip() and not re.search(r"[\r\n]", value):
        return f"{field}: {value}", False
    return f"{field}: {quote(value, safe=SAFE_MARKS)}", True


def build_record(row: dict) -> bytes:
    """A WARC/1.1 record.  Responses hold an HTTP message around the payload; a
    revisit holds only the message's head."""
    payload = row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + payload
    lines, coded = ["WARC/1.1"], []
    for column, field in FIELDS.items():
        value = length if column == "payload_length" else row[column]
        if value is not None:
            line, changed = header_line(field, str(value))
            lines.append(line)
            coded += [field] * changed
    if coded:
        lines.append(f"{CODED}: {' '.join(coded)}")
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """One gzip member whose extra field "sl" holds its own and the full length."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]
    records: int


class WarcWriter(DataSourceArrowWriter):
    """Option `file_bytes`: a task begins a new file beyond it."""

    def __init__(self, path: str, options: dict, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = open_store(self.path)
        names, n, size, out = [], 0, 0, None
        for batch in iterator:
            for at in range(batch.num_rows):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(posixpath.join(base, names[-1]), compression=None), 0
                member = gzip_member(build_record({k: batch.column(i)[at].as_py() for i, k in enumerate(batch.schema.names)}))
                out.write(member)
                n, size = n + 1, size + len(member)
                if size > self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(tuple(names), n)

    def commit(self, messages: list[Written | None]) -> None:
        """Names this job's files; an overwriting job then takes back the manifests before it."""
        fs, base = open_store(self.path)
        fs.create_dir(base, recursive=True)
        before = manifests(fs, base) if self.overwrite else []
        with fs.open_output_stream(posixpath.join(base, f"{MANIFEST}-{uuid.uuid4().hex}.json")) as out:
            out.write(json.dumps([x for m in messages if m for x in m.files]).encode())
        for path in before:
            fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = open_store(self.path)
        for m in messages:
            for x in m.files if m else ():
                fs.delete_file(posixpath.join(base, x))


def manifests(fs: pafs.FileSystem, base: str) -> list[str]:
    if fs.get_file_info(base).type != pafs.FileType.Directory:
        return []
    found = fs.get_file_info(pafs.FileSelector(base))
    return sorted(i.path for i in found if i.base_name.startswith(MANIFEST) and i.base_name.endswith(".json"))


@dataclass
class Archive(InputPartition):
    files: tuple[str, ...]


class WarcReader(DataSourceReader):
    """Option `payload` = "false" leaves the payload column null and its bytes
    inflated by nobody; `partition_bytes` bounds the files read by one task."""

    def __init__(self, path: str, options: dict):
        self.path = path
        self.payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", 32_000_000))
        self.wanted: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in FIELDS and f.attribute[0] not in self.wanted:
                self.wanted[f.attribute[0]] = str(f.value)
            else:
                yield f

    def partitions(self) -> list[Archive]:
        fs, base = open_store(self.path)
        if jobs := manifests(fs, base):
            infos = []
            for job in jobs:
                with fs.open_input_stream(job) as f:
                    infos += fs.get_file_info([posixpath.join(base, x) for x in json.loads(f.read())])
            if gone := [i.path for i in infos if i.type != pafs.FileType.File]:
                raise FileNotFoundError(f"named by a manifest but not there: {gone[:3]}")
        else:  # archives from elsewhere
            found = fs.get_file_info(pafs.FileSelector(base, recursive=True)) if fs.get_file_info(base).type == pafs.FileType.Directory else fs.get_file_info([base])
            infos = [i for i in found if i.path.endswith((".warc", ".warc.gz"))]
        out, group, size = [], [], 0
        for i in sorted(infos, key=lambda i: i.path):
            if group and size + i.size > self.partition_bytes:
                out.append(Archive(tuple(group)))
                group, size = [], 0
            group.append(i.path)
            size += i.size
        return [*out, Archive(tuple(group))]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        fs, _ = open_store(self.path)
        schema = pa.schema([(k, {"payload_length": pa.int64(), "payload": pa.binary()}.get(k, pa.string())) for k in [*FIELDS, "payload"]])
        rows, size = [], 0
        for name in partition.files:
            with fs.open_input_file(name) as f:
                for row in read_archive(f, self.wanted, self.payload):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 300
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the ones that this writer coded are decoded."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    for name in fields.get(CODED.lower(), "").lower().split():
        if name in fields:
            fields[name] = unquote(fields[name])
    return fields


def wanted_row(fields: dict[str, str], wanted: dict[str, str]) -> dict | None:
    row = {column: fields.get(field.lower()) for column, field in FIELDS.items()}
    if any(row[k] != v for k, v in wanted.items()):
        return None
    row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
    return row


def payload_of(block: bytes, fields: dict[str, str]) -> bytes:
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class Source:
    """A file read forward.  Requests double while it is read without gaps, so small
    records share them; behind a gap they begin small again, so what is skipped is
    not fetched."""

    def __init__(self, f):
        self.f, self.size = f, f.size()
        self.start, self.held, self.ahead = 0, b"", HEAD_BYTES

    def at(self, pos: int, n: int) -> bytes:
        """Up to n bytes at a position; fewer at the end of the file only."""
        end = self.start + len(self.held)
        if self.start <= pos and pos + n <= end:
            return self.held[pos - self.start : pos - self.start + n]
        near = self.held and self.start <= pos <= end + self.ahead
        self.ahead = min(2 * self.ahead, AHEAD_BYTES) if near else HEAD_BYTES
        kept = self.held[pos - self.start :] if self.start <= pos < end else b""
        self.f.seek(pos + len(kept))
        self.held = kept + self.f.read(min(max(n, self.ahead) - len(kept), self.size - pos - len(kept)))
        self.start = pos
        return self.held[:n]


class Plain:
    """The bytes of an uncompressed archive from a position on."""

    def __init__(self, source: Source, pos: int):
        self.source, self.pos = source, pos

    def read(self, n: int) -> bytes:
        data = self.source.at(self.pos, n)
        self.pos += len(data)
        return data

    def skip(self, n: int) -> int:
        n = min(n, self.source.size - self.pos)
        self.pos += n
        return n


class Member:
    """The bytes of one gzip member; `pos` is its end once it is read through."""

    def __init__(self, source: Source, pos: int):
        self.source, self.pos, self.raw, self.z = source, pos, b"", zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        while not self.z.eof:
            if not self.raw:
                self.raw = self.source.at(self.pos, 2048)
                self.pos += len(self.raw)
                if not self.raw:
                    raise ValueError("a gzip member is cut short")
            data = self.z.decompress(self.raw, n)
            self.raw = self.z.unconsumed_tail
            if self.z.eof:
                self.pos -= len(self.z.unused_data)
            if data:
                return data
        return b""

    def skip(self, n: int) -> int:
        done = 0
        while done < n and (data := self.read(min(n - done, 1 << 20))):
            done += len(data)
        return done


def next_head(stream: "Rest") -> bytes | None:
    """The headers of the next record and what was read beyond them, without the line
    ends that close the record before; None at the end."""
    head = b""
    while True:
        more = stream.read(HEAD_BYTES)
        head = (head + more).lstrip(b"\r\n") if not head else head + more
        if b"\r\n\r\n" in head:
            return head
        if not more:
            if head:
                raise ValueError("a record ends inside its headers")
            return None


class Rest:
    """A stream with bytes put back before it."""

    def __init__(self, stream: Plain | Member):
        self.stream, self.back = stream, b""

    def read(self, n: int) -> bytes:
        if self.back:
            data, self.back = self.back[:n], self.back[n:]
            return data
        return self.stream.read(n)

    def skip(self, n: int) -> int:
        held = min(n, len(self.back))
        self.back = self.back[held:]
        return held + (self.stream.skip(n - held) if n > held else 0)

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left and (data := self.read(min(left, 1 << 20))):
            parts.append(data)
            left -= len(data)
        return b"".join(parts)


def records_of(stream: Rest, wanted: dict[str, str], payload: bool) -> Iterator[dict | None]:
    """A row for each record of a stream, None for one that is not wanted; headers
    come first, and only a wanted payload is kept."""
    while (head := next_head(stream)) is not None:
        top, _, stream.back = head.partition(b"\r\n\r\n")
        fields = parse_head(top)
        row, n = wanted_row(fields, wanted), int(fields["content-length"])
        if row is None or not payload:
            if row is not None:
                row["payload"] = None
            yield row
            got = stream.skip(n)
        else:
            block = stream.take(n)
            got = len(block)
            row["payload"] = payload_of(block, fields)
        if got < n:
            raise ValueError("a record ends inside its block")
        if row is not None and payload:
            yield row


def read_archive(f, wanted: dict[str, str], payload: bool) -> Iterator[dict]:
    """Rows of the records that have the wanted header values.

    Plain archives, and gzip members of one or of many records.  A member whose
    extra field tells its length holds one record, and is left at its headers when
    its payload is not wanted.  A file that ends inside a record raises."""
    source, pos = Source(f), 0
    while pos < source.size:
        first = source.at(pos, 20)
        if first[:2] != b"\x1f\x8b":
            yield from (row for row in records_of(Rest(Plain(source, pos)), wanted, payload) if row is not None)
            return
        member = Member(source, pos)
        known = struct.unpack("<I", first[16:20])[0] if len(first) == 20 and first[3] & 4 and first[12:14] == b"sl" else 0
        for row in records_of(Rest(member), wanted, payload):
            if row is not None:
                yield row
            if known and (row is None or not payload):
                break
        pos = pos + known if known else member.pos
        if pos > source.size:
            raise ValueError("a gzip member is cut short")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """WARC records of `page_id, url, html` rows.

    Of pages with equal payloads of at least `min_revisit_bytes`, the one with the
    smallest page_id is the response and the others are revisits of it (without
    their payload); smaller payloads are all responses.  Null html is an empty
    payload, a null url has no target field; rows that repeat a page_id follow the
    same rule, so the repeats of a response are responses too; other columns are
    left out.

    Payload digests are grouped with counts combined on the map side; only the one
    shuffle of that join carries the html, and a hot digest is split by Spark's
    skew join since both sides are plain inputs of it."""
    sized = pages.select(
        F.col("page_id"), F.col("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    firsts = (
        sized.filter(F.col("payload_length") >= min_revisit_bytes)
        .groupBy(F.col("payload_digest").alias("d")).agg(F.min("page_id").alias("first_id"))
    )
    joined = sized.join(firsts, sized.payload_digest == firsts.d, "left")
    again = F.col("first_id") < F.col("page_id")
    revisit = F.coalesce(again, F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return joined.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("2020-01-01T00:00:00Z").alias("warc_date"),
        F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"),
        F.when(revisit, urn(F.col("first_id"))).alias("refers_to"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archives(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)

