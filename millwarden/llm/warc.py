"""WARC archives as a Spark data source, and pages as response and revisit records.

``spark.dataSource.register(WarcSource)`` gives format ``warc``.  A record is a gzip member of its own whose header carries
the lengths of the member (the extra field ``sl``), so a reader can leave a record after its headers.  The writer starts a new
file every FILE_BYTES; the commit writes a manifest of the files that count, so what a lost attempt left is never read.  The
reader plans one partition per file (of a folder without a manifest, per ``*.warc`` or ``*.warc.gz`` file, whoever wrote it), takes equality, IN and prefix predicates on the header columns, parses the headers of a
record first and inflates the rest only if it passes and the payload is wanted (option ``payload``).

Defined results: a null body is an empty payload; a null URL makes a record without target; a null key makes an id without
key and cannot be the record that others revisit; of repeated keys with equal payloads each row is a record, the response
among them being every row with the least key; control characters in URLs are percent-encoded; an empty table makes an archive
without records.  Other columns of the pages are not written.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from millwarden.llm.common import file_system

FILE_BYTES, LEVEL, HEAD = 64 << 20, 6, 4096
SALTS = 16
LEAST_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
HEADER_OF = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
             "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length"}


def member(raw: bytes) -> bytes:
    """A gzip member with its compressed and raw length in the extra field ``sl``."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, length: int, refers_to: str | None, date: str = DATE) -> bytes:
    """A whole record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def records(file, size: int, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records whose headers are wanted; others are left after their headers."""
    at = 0
    while at < size:
        file.seek(at)
        data = file.read(HEAD)
        if data[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        skip, start = None, 10
        if data[3] & 4:
            n = struct.unpack_from("<H", data, 10)[0]
            k, start = 12, 12 + n
            while k + 4 <= 12 + n:
                name, length = struct.unpack_from("<2sH", data, k)
                if name == b"sl" and length == 8:
                    skip = struct.unpack_from("<II", data, k + 4)[0]
                k += 4 + length
        for flag in (8, 16):  # a name and a comment, each ended by a zero byte
            if data[3] & flag:
                start = data.index(b"\0", start) + 1
        start += 2 if data[3] & 2 else 0
        inflate, raw, pending = zlib.decompressobj(-15), b"", data[start:]
        while b"\r\n\r\n" not in raw and not inflate.eof:
            pending = pending or file.read(HEAD)
            if not pending:
                raise ValueError("record is cut off")
            raw += inflate.decompress(pending, HEAD)
            pending = inflate.unconsumed_tail
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = _parsed(head)
        take = wanted(headers)
        if skip is None or (take and payload):
            parts = [rest]
            while not inflate.eof:
                pending = pending or file.read(1 << 16)
                if not pending:
                    raise ValueError("record is cut off")
                parts.append(inflate.decompress(pending))
                pending = inflate.unconsumed_tail
            rest = b"".join(parts)
            if len(rest) > int(headers.get("content-length", 0)) + 4:
                raise ValueError("a member holds more than one record")
        # A member ends by 8 bytes of checks, behind what was inflated.
        at = at + skip if skip is not None else file.tell() - len(inflate.unused_data) + 8
        if take:
            block = rest[: int(headers.get("content-length", 0))] if payload else b""
            body = block.partition(b"\r\n\r\n")[2] if payload and headers.get("warc-type") == "response" else None
            yield headers, body


def plain_records(file, size: int, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """As ``records``, of a file that is not compressed."""
    at = 0
    while at < size:
        file.seek(at)
        raw = b""
        while b"\r\n\r\n" not in raw:
            more = file.read(HEAD)
            if not more:
                if not raw.strip():
                    return
                raise ValueError("record is cut off")
            raw += more
        opening = len(raw) - len(raw.lstrip(b"\r\n"))
        head = raw[opening:].partition(b"\r\n\r\n")[0]
        headers = _parsed(head)
        start, length = at + opening + len(head) + 4, int(headers.get("content-length", 0))
        if start + length > size:
            raise ValueError("record is cut off")
        at = start + length + 4
        if wanted(headers):
            body = None
            if payload and headers.get("warc-type") == "response":
                file.seek(start)
                body = file.read(length).partition(b"\r\n\r\n")[2]
            yield headers, body


@dataclass
class FilePartition(InputPartition):
    name: str
    size: int


@dataclass
class FilesWritten(WriterCommitMessage):
    files: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.payload, self.tests = options["path"], options.get("payload", "true") == "true", []

    def pushFilters(self, filters):  # noqa: N802 - the name is Spark's
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 else None
            if column not in HEADER_OF or column == "payload_length":
                yield f
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", f.value))
            else:
                self.tests.append((column, "in", tuple(f.value) if isinstance(f, In) else (f.value,)))

    def partitions(self):
        system, folder = file_system(self.folder)
        listed = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        manifests = [info for info in listed if info.base_name.startswith("_manifest-")]
        found = {}
        for info in manifests:
            with system.open_input_file(info.path) as file:
                found.update(json.loads(file.read()))
        if not manifests:
            found = {info.base_name: info.size for info in listed if info.is_file and info.base_name.endswith((".warc", ".warc.gz"))}
            if not found:
                raise FileNotFoundError(f"no WARC file in {self.folder}")
        return [FilePartition(f"{folder}/{name}", size) for name, size in sorted(found.items())] or [FilePartition("", 0)]

    def _column(self, headers: dict[str, str], column: str):
        value = headers.get(HEADER_OF[column].lower())
        return value.removeprefix("sha256:") if column == "payload_digest" and value else value

    def _wanted(self, headers: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            found = self._column(headers, column)
            if found is None or not (found.startswith(value) if kind == "prefix" else found in value):
                return False
        return True

    def read(self, partition):
        if not partition.name:
            return
        system, _ = file_system(self.folder)
        with system.open_input_file(partition.name) as file:
            read = plain_records if partition.name.endswith(".warc") else records
            for headers, body in read(file, partition.size, self._wanted, self.payload):
                values = [self._column(headers, c) for c in HEADER_OF]
                yield (*values[:-1], int(values[-1]) if values[-1] is not None else None, body)


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, names: list[str]):
        self.folder, self.names = options["path"], names

    def write(self, iterator):
        system, folder = file_system(self.folder)
        system.create_dir(folder, recursive=True)
        task, files, out, held = TaskContext.get(), {}, None, 0
        for row in iterator:
            row = dict(zip(self.names, row))
            if out is None:
                name, held = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(files):03d}.warc.gz", 0
                out = system.open_output_stream(f"{folder}/{name}", compression=None)
            data = member(record(row["record_type"], row["record_id"], row["target_uri"], bytes(row["payload"] or b""), row["payload_digest"],
                                 row["payload_length"], row["refers_to"]))
            out.write(data)
            held += len(data)
            files[name] = held
            if held >= FILE_BYTES:
                out.close()
                out = None
        if out is not None:
            out.close()
        return FilesWritten(list(files.items()))

    def commit(self, messages):
        system, folder = file_system(self.folder)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(dict(x for m in messages if m is not None for x in m.files)).encode())


class WarcSource(DataSource):
    """Format ``warc``; options ``path`` and, to read headers alone, ``payload`` = false."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter(self.options, [f.name for f in schema.fields])


def _ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """The record of each page: of equal payloads of ``least`` bytes and more the least key responds, the others revisit it."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("target_uri"), F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long")})
    groups = rows.filter(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("key").alias("first")).filter("n > 1")
    # Copies of a page may be many: the few groups are copied to SALTS places, the pages of one are dealt over them.
    groups = groups.select("payload_digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    placed = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(groups, ["payload_digest", "salt"], "left")
    revisit = F.coalesce(F.col("first") != F.col("key"), F.col("first").isNotNull() & F.col("key").isNull())
    named = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(">"))
    return placed.select(F.when(revisit, "revisit").otherwise("response").alias("record_type"), named.alias("record_id"), "target_uri",
                         F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))).alias("refers_to"),
                         "payload_digest", "payload_length", F.when(~revisit, F.col("payload")).alias("payload"))


def write_warc(rows: DataFrame, folder: str) -> None:
    """Append records (columns of SCHEMA) to the archive in ``folder``, which driver and executors share."""
    _ready(rows.sparkSession)
    rows.write.format("warc").mode("append").option("path", folder).save()


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    _ready(spark)
    return spark.read.format("warc").option("path", folder).option("payload", str(payload).lower()).load()


def page_key(record_id) -> Column:
    """Key of a page from its record id."""
    return F.expr(f"try_cast(regexp_extract({record_id}, 'urn:page:(-?[0-9]+)', 1) AS BIGINT)")
