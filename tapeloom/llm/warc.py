"""WARC archives as a PySpark Python data source ("warc"), for reading and writing.

Writing: each task rolls its own gzip archives, a member per record, whose header carries the member's
length in the "sl" extra field that the WARC annex on compression describes. The driver's commit lists
the files of the tasks that succeeded in a manifest; files of lost attempts are not in it.

Reading: a partition per archive of the manifest (or per *.warc, *.warc.gz file of a folder without
one). Headers are parsed first: record type and header predicates are pushed down, a record that
they rule out, and every payload when option payload is "false", is skipped without being inflated.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from tapeloom.llm.common import shared_path, text_of

ROLL_BYTES = 128 << 20
MANIFEST = "_manifest.json"
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, content_length bigint, payload_bytes bigint, payload binary"
_FIELDS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    """A gzip member with its compressed and plain length in the extra field sl."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(record_id: str, record_type: str, target_uri: str | None, payload_digest: str, refers_to: str | None, payload: bytes) -> bytes:
    """A response with an HTTP header and the payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{_clean(record_id)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if target_uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(target_uri)}")
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_clean(refers_to)}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        for b in iterator:
            for row in zip(*(b.column(c).to_pylist() for c in ("record_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload"))):
                if out is None or size > ROLL_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(posixpath.join(path, files[-1]), compression=None), 0
                data = member(record(*row[:5], row[5] or b""))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(posixpath.join(path, MANIFEST)) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = filesystem(self.path)
        for m in messages:
            for x in m.files if m else ():
                fs.delete_file(posixpath.join(path, x))


class Archive:
    """Records of one archive in turn: the header of each, and its block only when asked for."""

    CHUNK = 1 << 12

    def __init__(self, file, compressed: bool):
        self.file, self.compressed, self.at, self.size = file, compressed, 0, file.size()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, self.size - at))

    def records(self, wanted, need_block: bool) -> Iterator[tuple[dict, bytes]]:
        """(header, as much of the block as was needed) of the records that `wanted` accepts by their header."""
        while self.at < self.size:
            start, raw = self.at, self._read(self.at, self.CHUNK)
            inflate, end = None, None
            plain = raw
            if self.compressed:
                if raw[:2] != b"\x1f\x8b":
                    raise ValueError(f"no gzip member at byte {start}")
                skip = 10
                if raw[3] & 4:
                    n = struct.unpack_from("<H", raw, 10)[0]
                    extra, skip, k = raw[12 : 12 + n], 12 + n, 0
                    while k + 4 <= len(extra):
                        size = struct.unpack_from("<H", extra, k + 2)[0]
                        if extra[k : k + 2] == b"sl":
                            end = start + struct.unpack_from("<I", extra, k + 4)[0]
                        k += 4 + size
                inflate = zlib.decompressobj(31)
                plain = inflate.decompress(raw)
            got = len(raw)

            def more() -> bool:
                nonlocal plain, got
                data = self._read(start + got, 1 << 18)
                got += len(data)
                plain += inflate.decompress(data) if inflate else data
                return bool(data) and not (inflate and inflate.eof)

            while b"\r\n\r\n" not in plain and more():
                pass
            head, _, block = plain.partition(b"\r\n\r\n")
            header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
            length = int(header["content-length"])
            accept = wanted(header)
            whole = len(head) + 4 + length
            while accept and len(plain) < whole and (need_block or b"\r\n\r\n" not in plain[len(head) + 4 :]) and more():
                pass
            if self.compressed and end is None:  # no length in the header: only the end of the stream tells
                while not inflate.eof and more():
                    pass
                end = start + got - len(inflate.unused_data)
            self.at = end if self.compressed else start + whole + 4
            if accept:
                yield header, plain[len(head) + 4 : whole]


@dataclass
class _File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _FIELDS and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.tests.append((name, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = filesystem(self.path)
        if fs.get_file_info(path).type == pafs.FileType.File:
            return [_File(self.path)]
        manifest = posixpath.join(path, MANIFEST)
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                names = json.loads(f.read())
        else:
            names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith((".warc", ".warc.gz")))
        return [_File(f"{self.path.rstrip('/')}/{x}") for x in names] or [_File("")]

    def _wanted(self, header: dict) -> bool:
        for name, kind, value in self.tests:
            v = _value(header, name)
            if v is None or kind == "EqualTo" and v != value or kind == "In" and v not in value or kind == "StringStartsWith" and not v.startswith(value):
                return False
        return True

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, path = filesystem(partition.path)
        rows, held = [], 0
        with fs.open_input_file(path) as file:
            for header, block in Archive(file, path.endswith(".gz")).records(self._wanted, self.payload):
                http, _, body = block.partition(b"\r\n\r\n")
                claimed = next((int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                payload = body if self.payload and header.get("warc-type") != "revisit" else None
                rows.append((*(_value(header, k) for k in _FIELDS), int(header["content-length"]), claimed, payload))
                held += 500 + len(payload or b"")
                if held > 8 << 20:
                    yield _rows(rows)
                    rows, held = [], 0
        if rows:
            yield _rows(rows)


def _value(header: dict, name: str) -> str | None:
    v = header.get(_FIELDS[name].lower())
    return v.strip("<>") if v is not None and name in ("record_id", "refers_to") else v.removeprefix("sha1:") if v is not None and name == "payload_digest" else v


_ARROW = pa.schema([*((k, pa.string()) for k in _FIELDS), ("content_length", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_sha1(payload: Column) -> Column:
    """RFC 4648 base32 of the SHA-1 of a binary column, in the JVM: 40 bits are 8 digits."""
    sha = F.sha1(payload)
    digits = F.concat(*(F.lpad(F.conv(F.substring(sha, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


ID_PREFIX = "urn:page:"


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """WARC records of pages: of equal payloads that with the smallest id is the response, the others revisit it.

    Null payloads count as empty. A page without an id is a response of its own. Rows that repeat an id
    and a payload have equal records. Further columns of `pages` are not looked at.
    """
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].alias("target_uri"), F.encode(text_of(pages, html_col), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload")))
    light = rows.select("id", "payload_digest", F.length("payload").alias("n")).where("id is not null")
    first = light.groupBy("payload_digest", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    revisits = light.join(first, ["payload_digest", "n"]).where("id != first").select("id", "payload_digest", "first").distinct()
    named = lambda c: F.concat(F.lit(ID_PREFIX), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.join(revisits, ["id", "payload_digest"], "left").select(
        named("id").alias("record_id"), F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), "target_uri",
        F.when(F.col("first").isNotNull(), named("first")).alias("refers_to"), "payload_digest", F.lit(None).cast("long").alias("content_length"), F.length("payload").cast("long").alias("payload_bytes"), "payload",
    )


def write_warc(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    page = lambda c: F.substring(c, len(ID_PREFIX) + 1, 20).cast("long")
    full = read_warc(spark, path).where("record_type = 'response'").select("record_id", "record_type", "refers_to", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    headers = read_warc(spark, path, payload=False).where("record_type = 'revisit'").select("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    return full.union(headers).select(F.expr(f"try_cast(substring(record_id, {len(ID_PREFIX) + 1}) as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {10 * g + 1}, 10) AS BIGINT) >> {35 - 5 * k}) & 31 AS BIGINT) + 1, 1)" for g in range(4) for k in range(8))
OP6_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), s AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
d AS (SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_B32} AS payload_digest FROM s),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

QUERIES = {"op6_warc": op6_warc}
ORACLE_SQL = {"op6_warc": OP6_SQL}
