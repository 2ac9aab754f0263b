"""Token-ID output (operator 7): a binary file format of fixed-width ids, and its writer and reader on Spark.

A file holds ids of `bits` bits each, the fewest that the vocabulary needs. 64 ids make `bits` 64-bit words exactly, so packing and
unpacking are 64 column operations in numpy whatever the width. Ids lie in blocks of BLOCK ids (the last one shorter, padded to 64):

    magic "QFTOK001"
    the blocks, one after the other
    block offsets (u64, one more than blocks) | doc ids (i64) | null marks (u8) | first id of each doc (u64, one more than docs)
    trailer: offset of the tables, blocks, docs, ids (u64 each), bits (u64), magic "QFTOK001"

The block offsets make any document a range read: its first id gives its block, the block its place in the file.

Writing. Documents are dealt by ranges of doc_id and sorted, each task encodes its range and writes one file under a name of its own
attempt, and only the manifest rows of tasks that ended well name files that count. The manifest has one row for each file, and so
the driver sees as many rows as there are range partitions. Reading takes one task for each file.

Defined results. Null text is empty and holds just the end id. Null doc_ids come first. Rows with equal doc_ids follow each other in
the order of their texts. An empty table makes no documents. Other columns aren't written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietframe.llm.common import Scratch, batches_of, filesystem, shuffle_partitions, slices, text_or_empty
from quietframe.llm.tokens import encoder

MAGIC = b"QFTOK001"
BLOCK = 1 << 16
_TRAILER = struct.Struct("<5Q8s")


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell `vocabulary` ids apart."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, little end first, padded with zeros to a multiple of 64 ids."""
    rows = -(-len(ids) // 64)
    x = np.zeros((rows, 64), np.uint64)
    x.reshape(-1)[: len(ids)] = ids
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    x = np.ascontiguousarray(x.T)
    out = np.zeros((bits, rows), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[word] |= x[j] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= x[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of what pack() made."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits).T.astype(np.uint64)
    out = np.empty((64, words.shape[1]), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            x |= words[word + 1] << np.uint64(64 - shift)
        out[j] = x & mask
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


class TokenWriter:
    """Writes one file; add() takes the ids of one document after the other."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.at = len(MAGIC)
        self.offsets, self.docs, self.nulls, self.starts = [self.at], [], [], [0]
        self.waiting: list[np.ndarray] = []
        self.held = 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 8 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        n = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, n, BLOCK):
            data = pack(ids[i : min(i + BLOCK, n)], self.bits)
            self.stream.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.waiting, self.held = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        """Documents and ids in the file."""
        self._flush(True)
        for x, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.nulls, "u1"), (self.starts, "<u8")):
            self.stream.write(np.array(x, dtype=kind).tobytes())
        self.stream.write(_TRAILER.pack(self.at, len(self.offsets) - 1, len(self.docs), self.starts[-1], self.bits, MAGIC))
        return len(self.docs), self.starts[-1]


class TokenFile:
    """Random access to one file: read only its tables, then the blocks that are asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        at, self.blocks, n, self.n_ids, self.bits, magic = _TRAILER.unpack(self._read(size - _TRAILER.size, size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        tables = self._read(at, size - _TRAILER.size)
        cut = np.cumsum([0, 8 * (self.blocks + 1), 8 * n, n, 8 * (n + 1)])
        self.offsets, self.doc_ids, self.nulls, self.starts = (np.frombuffer(tables[a:b], kind) for a, b, kind in zip(cut[:-1], cut[1:], ("<u8", "<i8", "u1", "<u8"), strict=True))

    def _read(self, a: int, b: int) -> bytes:
        self.source.seek(a)
        return self.source.read(b - a)

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids from place a to place b."""
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK, (b - 1) // BLOCK
        n = min((last + 1) * BLOCK, int(self.n_ids)) - first * BLOCK
        data = self._read(int(self.offsets[first]), int(self.offsets[last + 1]))
        return unpack(data, self.bits, n)[a - first * BLOCK : b - first * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self, most: int = 8 * BLOCK) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, first id's place, ids) of every document, reading about `most` ids at a time."""
        i, n = 0, len(self.doc_ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + most, "right")) - 1)
            a = int(self.starts[i])
            ids = self.ids(a, int(self.starts[j]))
            for k in range(i, j):
                yield (None if self.nulls[k] else int(self.doc_ids[k])), int(self.starts[k]), ids[int(self.starts[k]) - a : int(self.starts[k + 1]) - a]
            i = j


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int, partitions: int) -> list[dict]:
    """Writes docs (doc_id, text) in ascending doc_id order; the manifest, one row for each file, in file order."""
    bits = bits_for(max(vocabulary, end_id + 1))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, path = filesystem(f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.tok")
        end = np.array([end_id], np.uint32)
        writer = None
        for batch in batches:
            for part in slices(batch, "text"):
                if writer is None:
                    stream = fs.open_output_stream(path, compression=None)
                    writer = TokenWriter(stream, bits)
                ids, first = encoder(tokenizer).encode(part.column(1))
                first = first.tolist()
                for k, doc_id in enumerate(part.column(0).to_pylist()):
                    writer.add(doc_id, np.concatenate([ids[first[k] : first[k + 1]], end]))
        if writer is not None:
            n, ids = writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [path], "n_docs": [n], "n_ids": [ids]}, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    dealt = docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text")).repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    with batches_of(docs.sparkSession):
        rows = dealt.mapInArrow(write, "part int, path string, n_docs long, n_ids long").collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r["part"])]


def read_tokens(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; one task for each file."""
    first = np.cumsum([0, *[m["n_ids"] for m in manifest]]).tolist()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                fs, _ = filesystem(folder)
                with fs.open_input_file(manifest[k]["path"]) as source:
                    out: list[tuple] = []
                    for doc_id, start, ids in TokenFile(source).documents():
                        out.append((doc_id, first[k] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(out) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    n = len(manifest)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame, spark: SparkSession, tokenizer: str, vocabulary: int, end_id: int) -> DataFrame:
    folder = Scratch(spark, "tokens").folder("files")
    return read_tokens(spark, folder, write_tokens(docs, folder, tokenizer, vocabulary, end_id, shuffle_partitions(spark)))
