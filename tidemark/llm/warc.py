"""WARC archives as a PySpark Python data source, with revisit records for repeated payloads.

Writing: each task writes gzip members, one a record, to a file of its own, with
an index of record offsets beside it; the commit lists the files that count, so
a retried task's leftovers are never read. Reading: files are planned as ranges
of bytes by their sizes alone, and each task takes the records that begin in its
range from the file's index. Equality and IN predicates on the record type and the
header columns are pushed down, each record's headers are parsed from its first
bytes, and the payload of a record that is filtered out, or that the reader is
told to leave (option payload=false), is never decompressed. A foreign file without
an index is one partition that streams past: plain or in gzip members of any number
of records; unwanted payloads are passed over piece by piece.

Files are reached through pyarrow.fs, so a path may be any URI it knows.

Defined results: null html counts as empty, null url as an empty target; of
equal payloads the row with the largest page_id is the response (a null page_id
loses to any other, and rows with that same page_id are all responses); an empty
table gives an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import only, salts_for, scratch_dir

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, headers map<string,string>, payload binary"
ARROW = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
SPLIT_BYTES = 16 << 20  #: compressed bytes of a partition
BATCH_BYTES = 8 << 20
HEAD_BYTES = 2048  #: of a record that are read to find its headers
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(record_id: str, kind: str, uri: str, digest: str, refers_to: str | None, payload: bytes) -> bytes:
    """One record in bytes; a revisit keeps the payload's length in its HTTP header, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def _value(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(HEADER_OF[column])
    if value is not None and column in ("record_id", "refers_to"):
        value = value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha1:") if value is not None and column == "payload_digest" else value


@dataclass
class Commit(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Commit:
        files, root = _opened(self.path)
        files.create_dir(root, recursive=True)
        name, out, at, offsets = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, []
        try:
            for batch in iterator:
                out = out or files.open_output_stream(f"{root}/{name}", compression=None)
                for row in batch.to_pylist():
                    raw = record(row["record_id"], row["record_type"], row["target_uri"], row["payload_digest"], row["refers_to"], row["payload"] or b"")
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    member = packer.compress(raw) + packer.flush()
                    offsets.append(at)
                    out.write(member)
                    at += len(member)
        finally:
            if out:
                out.close()
        if not out:
            return Commit(None)
        with files.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
            index.write(json.dumps([*offsets, at]).encode())
        return Commit(name)

    def commit(self, messages: list[Commit | None]) -> None:
        files, root = _opened(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/_files", compression=None) as out:
            out.write(json.dumps([m.name for m in messages if m and m.name]).encode())

    def abort(self, messages: list[Commit | None]) -> None:
        files, root = _opened(self.path)
        for m in messages:
            if m and m.name:
                files.delete_file(f"{root}/{m.name}")


class Span(InputPartition):
    """Records of a file that begin from byte to byte, or a whole file where there is no index."""

    def __init__(self, path: str | None, first: int | None = None, stop: int | None = None):
        self.path, self.first, self.stop = path, first, stop


def _streamed(f: pa.NativeFile) -> Iterator[tuple[bytes, Callable[[], bytes]]]:
    """The records of a file without an index: first bytes, and how to get the rest before the next one is asked for."""
    packed = f.read(2) == b"\x1f\x8b"
    f.seek(0)
    flow = gzip.GzipFile(fileobj=f) if packed else io.BufferedReader(f)
    while line := flow.readline():
        if not line.strip():
            continue
        head = line
        while (line := flow.readline()) not in (b"\r\n", b""):
            head += line
        left = int(_fields(head).get("content-length", 0))
        body = flow.read(min(left, HEAD_BYTES))
        state = [left - len(body)]

        def rest(state=state) -> bytes:
            size, state[0] = state[0], 0
            return flow.read(size)

        yield head + b"\r\n" + body, rest
        while state[0] > 0 and (piece := flow.read(min(state[0], 1 << 20))):
            state[0] -= len(piece)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.wanted: list[tuple[str, set[str]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_OF:
                self.wanted.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self) -> list[Span]:
        files, root = _opened(self.path)
        found = {i.base_name: i for i in files.get_file_info(fs.FileSelector(root))}
        names = sorted(n for n in found if re.search(r"\.warc(\.gz)?$", n))
        if "_files" in found:
            with files.open_input_stream(f"{root}/_files", compression=None) as f:
                names = sorted(json.loads(f.read()))
        out = []
        for name in names:
            if f"{name}.idx" in found:
                ends = range(0, found[name].size, SPLIT_BYTES)
                out += [Span(name, first, first + SPLIT_BYTES) for first in ends]
            else:
                out.append(Span(name))
        return out or [Span(None)]

    def _members(self, span: Span) -> Iterator[tuple[bytes, Callable[[], bytes]]]:
        """Each record's first bytes, and how to get the rest."""
        files, root = _opened(self.path)
        with files.open_input_file(f"{root}/{span.path}") as f:
            if span.first is None:
                yield from _streamed(f)
                return
            with files.open_input_stream(f"{root}/{span.path}.idx", compression=None) as index:
                offsets = json.loads(index.read())
            for k in range(bisect_left(offsets, span.first), min(bisect_left(offsets, span.stop), len(offsets) - 1)):
                f.seek(offsets[k])
                packed, opened = f.read(offsets[k + 1] - offsets[k]), zlib.decompressobj(31)
                head = opened.decompress(packed, HEAD_BYTES)
                while b"\r\n\r\n" not in head and opened.unconsumed_tail:
                    head += opened.decompress(opened.unconsumed_tail, HEAD_BYTES)
                yield head, lambda opened=opened: opened.decompress(opened.unconsumed_tail)

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if span.path is None:
            return
        rows, held = [], 0
        for raw, rest in self._members(span):
            cut = raw.index(b"\r\n\r\n")
            headers = _fields(raw[:cut])
            if any(_value(headers, c) not in values for c, values in self.wanted):
                continue
            body = raw[cut + 4 :]
            if self.payload or b"\r\n\r\n" not in body:
                body += rest()
            end = body.find(b"\r\n\r\n") if headers.get("content-type", "").startswith("application/http") else -4
            end = -4 if end < 0 else end
            http = _fields(body[:end]) if end >= 0 else {}
            size = int(headers.get("content-length", 0)) - end - 4
            payload = body[end + 4 : end + 4 + size] if self.payload and headers.get("warc-type") != "revisit" else None
            row = {c: _value(headers, c) for c in HEADER_OF}
            rows.append(row | {"payload_bytes": int(http.get("content-length", size)), "headers": list(headers.items()), "payload": payload})
            held += len(payload or b"") + 500
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder); option payload=false reads headers alone."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@F.pandas_udf(StringType())
def base32(column):
    """Base32 of hexadecimal digits."""
    return column.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode())


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """The WARC records of pages (page_id, url, html): a response for each distinct payload of at least `least` bytes, revisits for the rest."""
    rows = only(pages, "page_id", "url", "html").select(
        "page_id", F.coalesce("url", F.lit("")).alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")
    )
    keyed = rows.withColumns({"key": F.sha2("payload", 256), "salt": F.pmod(F.xxhash64("page_id"), F.lit(salts_for(pages.count()))).cast("int")})
    salted = keyed.groupBy("key", "salt").agg(F.max("page_id").alias("top"))
    winners = salted.groupBy("key").agg(F.max("top").alias("top"), F.collect_list("salt").alias("salts")).select("key", "top", F.explode("salts").alias("salt"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    joined = keyed.join(winners, ["key", "salt"])
    first = F.col("page_id").eqNullSafe(F.col("top")) | (F.length("payload") < least)
    return joined.select(
        urn(F.col("page_id")).alias("record_id"), F.when(first, "response").otherwise("revisit").alias("record_type"), F.regexp_replace("target_uri", "[\\r\\n]", " ").alias("target_uri"),
        base32(F.sha1("payload")).alias("payload_digest"), F.when(~first, urn(F.col("top"))).alias("refers_to"), "payload",
    )


def write_archive(pages: DataFrame, path: str, least: int = 0) -> None:
    register(pages.sparkSession)
    records(pages, least).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from an archive of pages in the shared folder."""
    path = f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, least)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes"))
    return read_archive(pages.sparkSession, path).select(
        page("record_id").alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )
