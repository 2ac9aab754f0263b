"""WARC archives (operator 6) with a two-level capture index.

Archives. Every page becomes one record, its own gzip member, in WARC/1.1 files of one task each. Of the records with equal payloads (by
SHA-1), of `least` bytes or more, the one with the smallest page_id is a response and the others revisit it; smaller payloads are all responses.
The groups are found on thin rows with a partial aggregate and joined to the pages by a plain shuffled join on the digest, so adaptive
execution splits the partition of a payload that fills a third of the rows.

Index. A capture's key is its URL with the host reversed (com,example,www)/path) and then its page_id. Keys are sorted over ranges; each
range is a file of compressed blocks of BLOCK lines (key, archive, offset, length), then the block directory: each block's first key and
place. The manifest names each file with its first key, one row for each range partition. A lookup bisects the manifest, the directory
and the block's lines, and then reads just the capture's range of the archive. Ranges are over (URL, page_id), so captures of one URL spread.

Reading back looks every (key, page_id) of the table up in the index, by ranges of keys, and parses what it points to. Payload digests of
responses are made anew and compared.

Defined results. Null html is an empty payload. Null and odd urls have an empty or escaped key. Rows that agree in page_id and payload are
each a response (or each a revisit); null page_ids refer to a response if any with an id has their payload, else each is one. An empty table makes
no archive. Other columns aren't written. Archives of lost task attempts are never named by the manifest.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietframe.llm.common import Scratch, batches_of, filesystem, shuffle_partitions

BLOCK = 3_000
_PAGE, _NO_PAGE = 0x7061676500008000, 0x6E6F6E6500008000
_TRAILER = "<QQ8s"
_MAGIC = b"QFCDX001"
_BIAS = 1 << 63


def capture_key(url: Column, page_id: Column) -> Column:
    """The sort key of a capture: reversed host, rest of the URL, page_id. Lines hold it, so white space and control characters are escaped."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(url)
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)
    key = F.regexp_replace(F.coalesce(key, F.lit("")), r"[\x00-\x20\x7F]", "%20")
    number = F.lpad((page_id.cast("decimal(20,0)") + F.lit(str(_BIAS)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.concat(key, F.lit(" "), F.coalesce(number, F.lit("")))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(_NO_PAGE if page_id is None else _PAGE) << 64 | ((page_id or 0) & (2**64 - 1)))}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = n & (2**64 - 1)
    return None if n >> 64 == _NO_PAGE else low - 2**64 if low >= _BIAS else low


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One gzip member. A revisit has the HTTP header alone, and the payload's length in a field of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    fields += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Payload-Length: {len(payload)}"]
    return gzip.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one gzip member."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, least: int) -> DataFrame:
    """Writes all records; ckey, archive, offset, length of each."""
    digest = F.sha1(F.col("html"))
    thin = pages.select("page_id", "html").withColumn("digest", digest).filter(F.octet_length("html") >= least)
    groups = thin.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    rows = pages.withColumn("digest", F.when(F.octet_length("html") >= least, digest)).join(groups, "digest", "left")
    rows = rows.select("page_id", "url", "html", "ckey", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))
    schema = pa.schema([("ckey", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"warc-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        stream, at = None, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lines = []
                for page_id, url, html, ckey, first, revisit in zip(*[part.column(i).to_pylist() for i in range(6)], strict=True):
                    payload = html.encode()
                    record = make_record(page_id, url, payload, base32_sha1(payload), first, revisit)
                    if stream is None:
                        fs, path = filesystem(f"{folder}/{name}")
                        stream = fs.open_output_stream(path, compression=None)
                    stream.write(record)
                    lines.append((ckey, name, at, len(record)))
                    at += len(record)
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), schema.types, strict=True)], schema=schema)
        if stream is not None:
            stream.close()

    return rows.mapInArrow(write, "ckey string, archive string, offset long, length long")


def write_index(captures: DataFrame, folder: str, partitions: int) -> list[dict]:
    """Sorts captures into blocks; the manifest, one row for each file, in key order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"index-{task.partitionId():06d}-{task.taskAttemptId()}.cdx"
        stream, at, held, directory, rows = None, 0, [], [], 0

        def block() -> None:
            nonlocal stream, at, held
            if stream is None:
                fs, path = filesystem(f"{folder}/{name}")
                stream = fs.open_output_stream(path, compression=None)
            data = zlib.compress("\n".join("\t".join(map(str, x)) for x in held).encode(), 6)
            stream.write(data)
            directory.append((held[0][0], at, len(data)))
            at, held = at + len(data), []

        for batch in batches:
            for line in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                held.append(line)
                rows += 1
                if len(held) == BLOCK:
                    block()
        if held:
            block()
        if stream is not None:
            data = zlib.compress(json.dumps(directory).encode(), 6)
            stream.write(data)
            stream.write(struct.pack(_TRAILER, at, len(data), _MAGIC))
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "first": [directory[0][0]], "rows": [rows]}, schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("first", pa.string()), ("rows", pa.int64())]))

    dealt = captures.repartitionByRange(partitions, "ckey", "archive", "offset").sortWithinPartitions("ckey", "archive", "offset")
    return [r.asDict() for r in sorted(dealt.mapInArrow(write, "part int, name string, first string, rows long").collect(), key=lambda r: r["part"])]


class CaptureIndex:
    """Lookups in the index and range reads of the archives. Few files, directories and blocks are held at a time."""

    def __init__(self, folder: str, manifest: list[dict], files: int = 32):
        self.fs, self.folder = filesystem(folder)
        self.names, self.firsts = [m["name"] for m in manifest], [m["first"].encode() for m in manifest]
        self.files = files
        self.open: dict[str, object] = {}
        self.directories: dict[int, tuple[list[bytes], list]] = {}
        self.block: tuple[tuple[int, int], list[bytes], list[list[str]]] | None = None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= self.files:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.folder}/{name}")
        f = self.open[name]
        f.seek(offset)
        return f.read(length)

    def directory(self, part: int) -> tuple[list[bytes], list]:
        if part not in self.directories:
            if len(self.directories) >= 4:
                self.directories.pop(next(iter(self.directories)))
            name = self.names[part]
            with self.fs.open_input_file(f"{self.folder}/{name}") as f:
                size = f.size()
            at, length, magic = struct.unpack(_TRAILER, self.read(name, size - struct.calcsize(_TRAILER), struct.calcsize(_TRAILER)))
            if magic != _MAGIC:
                raise ValueError("not an index file")
            blocks = json.loads(zlib.decompress(self.read(name, at, length)))
            self.directories[part] = [b[0].encode() for b in blocks], blocks
        return self.directories[part]

    def lines(self, part: int, number: int) -> tuple[list[bytes], list[list[str]]]:
        if self.block is None or self.block[0] != (part, number):
            _, at, length = self.directory(part)[1][number]
            lines = [x.split("\t") for x in zlib.decompress(self.read(self.names[part], at, length)).decode().split("\n")]
            self.block = (part, number), [x[0].encode() for x in lines], lines
        return self.block[1:]

    def find(self, key: str, prefix: bool = False) -> Iterator[tuple[str, str, int, int]]:
        """(key, archive, offset, length) of every capture with this key; with prefix, of all whose keys begin so."""
        k = key.encode()
        part = max(0, bisect.bisect_left(self.firsts, k) - 1)
        while part < len(self.names) and (self.firsts[part] <= k or prefix and self.firsts[part].startswith(k)):
            firsts, _ = self.directory(part)
            number = max(0, bisect.bisect_left(firsts, k) - 1)
            while number < len(firsts) and (firsts[number] <= k or prefix and firsts[number].startswith(k)):
                keys, lines = self.lines(part, number)
                i = bisect.bisect_left(keys, k)
                while i < len(keys) and (keys[i] == k or prefix and keys[i].startswith(k)):
                    yield lines[i][0], lines[i][1], int(lines[i][2]), int(lines[i][3])
                    i += 1
                if i < len(keys):
                    return
                number += 1
            part += 1

    def record(self, archive: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        return parse_record(self.read(archive, offset, length))


def read_captures(keys: DataFrame, folder: str, manifest: list[dict], partitions: int) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture with one of the keys (ckey, each once)."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or CaptureIndex(folder, manifest)
            for a in range(0, batch.num_rows, 1024):
                places = [p for k in batch.column(0).slice(a, 1024).to_pylist() for p in index.find(k)]
                out = []
                for _, archive, offset, length in sorted(places, key=lambda p: p[1:3]):
                    fields, payload = index.record(archive, offset, length)
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have its digest")
                    n = len(payload) if kind == "response" else int(fields["X-Payload-Length"])
                    out.append((page_of(fields["WARC-Record-ID"]), n, digest, kind, page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    dealt = keys.repartitionByRange(partitions, "ckey").sortWithinPartitions("ckey")
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_and_read(pages: DataFrame, spark: SparkSession, least: int = 0) -> DataFrame:
    scratch, partitions = Scratch(spark, "warc"), shuffle_partitions(spark)
    folder = scratch.folder("archives")
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("ckey", capture_key(F.col("url"), F.col("page_id")))
    with batches_of(spark):
        captures = scratch.table(write_archives(rows, folder, least), "captures")
    manifest = write_index(captures, folder, partitions)
    return read_captures(rows.select("ckey").distinct(), folder, manifest, partitions)
