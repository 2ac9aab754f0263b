"""What the operators share: scratch tables in the cluster's shared folder, and byte views of text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset (local tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quietframe-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables and files of one operator run in the shared folder. They go when the session's JVM ends, or earlier by drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def folder(self, name: str) -> str:
        """An empty folder for files that tasks write."""
        self._fs.mkdirs(self._path(self.path(name)))
        return self.path(name)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it again: its lineage is cut and a lost executor costs nothing that was written. The shuffle files of the
        write go at its end, not when the driver happens to collect garbage."""
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """names: tables or files, or patterns such as "edges*"; those that aren't there are passed over."""
        for name in names:
            for found in self._fs.globStatus(self._path(self.path(name))) or []:
                self._fs.delete(found.getPath(), True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting in what runs inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def batches_of(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of about `size` bytes in what runs inside; both sides of a worker's pipe hold a batch several times over."""
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size)):
        yield


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_uid():
    """A number for a row's doc_id and text (null: empty); rows that agree in both have the same."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), text_or_empty())


def filesystem(uri: str):
    """pyarrow's filesystem and path of a shared URI, for use on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without copying, and where each row begins (one more than rows). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, most: int = 2 << 20):
    """The batch in runs of rows whose texts take about `most` bytes, so that memory doesn't follow the batch's size."""
    _, offsets = column_bytes(batch.column(batch.schema.get_field_index(name)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i)
        i = j


#: Bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finishes a 64-bit hash (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(buf: np.ndarray, breaks: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of buf; no word runs over one of the positions in breaks."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~space[buf]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cut = breaks[(breaks > 0) & (breaks < n)]
    start[cut] = inside[cut]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cut - 1] = inside[cut - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hashes of buf[start:end] after folding each byte; equal words have equal hashes wherever they stand.

    Eight bytes at a time are mixed in, so words of one length up to eight bytes never collide; long words are hashed by XXH3."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    folded = np.zeros(len(buf) + 8, np.uint8)
    folded[: len(buf)] = fold[buf]
    lanes = np.ndarray((len(buf) + 1,), "<u8", folded, strides=(1,))
    size = ends - starts
    h = mix64(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (lanes[starts] & _KEEP[np.minimum(size, 8)])
    h = mix64(h)
    left = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    at = 8
    while len(left):
        h[left] = mix64(h[left] ^ (lanes[starts[left] + at] & _KEEP[np.minimum(size[left] - at, 8)]))
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(folded[starts[i] : ends[i]].tobytes())
    return h


def same_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether buf[start:end] and buf[starts[o]:ends[o]], o = other, are equal, for all at once."""
    size = ends - starts
    same = size == size[other]
    some = np.flatnonzero(same & (other != np.arange(len(other))) & (size > 0))
    if len(some):
        n = size[some]
        shift = np.cumsum(n) - n
        within = np.arange(int(n.sum()))
        differ = buf[within + np.repeat(starts[some] - shift, n)] != buf[within + np.repeat(starts[other[some]] - shift, n)]
        same[some] = ~np.logical_or.reduceat(differ, shift)
    return same


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; the last k - 1 positions have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix64(h)


def owned_shingles(words: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """owner and hash of every k words in a row that have one owner (owner ascends). An owner of fewer words has one: that of its whole
    sequence, with its length in the hash."""
    if not len(words):
        return owner, words
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    size = np.diff(np.append(first, len(owner)))
    whole = owner[k - 1 :] == owner[: max(0, len(owner) - k + 1)]
    mine, hashes = owner[: len(whole)][whole], shingle_hashes(words, k)[whole]
    first, size = first[size < k], size[size < k]
    if not len(first):
        return mine, hashes
    h = np.zeros(len(first), np.uint64)
    for i in range(k - 1):
        more = size > i
        h[more] = h[more] * np.uint64(0xD6E8FEB86659FD93) + words[first[more] + i]
    h = mix64(mix64(h) + size.astype(np.uint64))
    mine, hashes = np.concatenate([mine, owner[first]]), np.concatenate([hashes, h])
    order = np.argsort(mine, kind="stable")
    return mine[order], hashes[order]


def unique_rows(spark: SparkSession, names: list[str], taken: list[str]) -> dict[str, str]:
    """Names that clash with none of `taken`, for the columns that an operator adds for its own use."""
    out = {}
    low = {x.lower() for x in taken}
    for name in names:
        new = name
        while new.lower() in low:
            new = f"_{new}"
        low.add(new.lower())
        out[name] = new
    return out


def whole_groups(batches, columns: int, low_bits: int = 0):
    """From batches of rows sorted by their first column: lists of `columns` arrays that each hold whole groups of it (of what is over its
    low_bits lowest bits). A column of binary rows comes as an object array."""
    kept: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        kept = [np.concatenate(x) for x in zip(kept, cols, strict=True)] if kept else cols
        last = int(np.searchsorted(kept[0], kept[0][-1] >> low_bits << low_bits))
        if last:
            yield [c[:last] for c in kept]
            kept = [c[last:] for c in kept]
    if kept and len(kept[0]):
        yield kept


def capped_groups(batches, columns: int, low_bits: int, most: int):
    """As whole_groups, but never holds more than `most` rows of one group (and a batch): of a larger group only (group, rows) comes, as a pair
    of numbers, and its rows are let go."""
    kept: list[np.ndarray] = []
    large, passed = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if large is not None:
            end = int(np.searchsorted(cols[0] >> low_bits, large, "right"))
            passed += end
            if end == len(cols[0]):
                continue
            yield large, passed
            large, cols = None, [c[end:] for c in cols]
        kept = [np.concatenate(x) for x in zip(kept, cols, strict=True)] if kept else cols
        last = int(np.searchsorted(kept[0], kept[0][-1] >> low_bits << low_bits))
        if last:
            yield [c[:last] for c in kept]
            kept = [c[last:] for c in kept]
        if len(kept[0]) > most:
            large, passed, kept = int(kept[0][0] >> low_bits), len(kept[0]), []
    if large is not None:
        yield large, passed
    elif kept and len(kept[0]):
        yield kept
