"""Best-fit packing (operator 1) by a length-histogram plan.

Documents become pieces of at most `capacity` ids. Only the histogram of piece lengths (at most `capacity` numbers) reaches the driver.
There best-fit decreasing runs over counts: lengths from the largest, each length filling the open sequences with the least room that
takes it, in whole runs of equal sequences, and opening new ones for the rest. The plan is a list of runs

    (length, first rank, count, first sequence, offset)

whose number depends on the lengths that occur, not on the documents. Each piece then takes the slot of its rank within its length.

Ranks are counted in parallel: a length that holds many pieces is dealt over salts in proportion to its count, ranks are local to
(length, salt), and the counts of those (at most `capacity` and four for each shuffle partition) give each salt its first rank.

Defined results. Null text is empty: a piece of just the end id. Pieces tie in any order; repeated rows each take a slot. An empty table
makes no pieces. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietframe.llm.common import Scratch, batches_of, shuffle_partitions, slices, text_or_empty
from quietframe.llm.tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_RANK = 1 << 42


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The runs of the best-fit plan, and how many sequences it has. histogram: pieces by length, each from 1 to capacity."""
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a sequence with room r is open
    runs, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        nonlocal rooms
        if room and n:
            open_[room].append((first, n))
            rooms |= 1 << room

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                first, n = open_[room].pop()
                take = min(left, n)
                if take < n:
                    open_[room].append((first + take, n - take))
                if not open_[room]:
                    rooms &= ~(1 << room)
                runs.append((length, rank, take, first, capacity - room))
                put(room - length, first, take)
                rank, left = rank + take, left - take
                continue
            each = capacity // length
            for n, m in ((left // each, each), (1, left % each)):
                if n and m:
                    for i in range(m):
                        runs.append((length, rank, n, sequences, i * length))
                        rank += n
                    put(capacity - m * length, sequences, n)
                    sequences += n
            left = 0
    return runs, sequences


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; a narrow pass over the texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                every, first = encoder(tokenizer).encode(part.column(1))
                first = first.tolist()
                for k, doc_id in enumerate(part.column(0).to_pylist()):
                    ids = every[first[k] : first[k + 1]].astype("<u4").tobytes() + end
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc_id, i, at // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text")).mapInArrow(cut, PIECE)


def place(pieces: DataFrame, capacity: int, partitions: int) -> DataFrame:
    """pieces (a table with a length, cheap to read again) with sequence_id and offset."""
    histogram = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}
    total = sum(histogram.values())
    runs, _ = plan(histogram, capacity)
    salts = [1] * (capacity + 1)
    for length, n in histogram.items():
        salts[length] = max(1, math.ceil(4 * partitions * n / max(1, total)))
    others = [c for c in pieces.columns if c not in ("length",)]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*others), F.element_at(F.from_json(F.lit(json.dumps(salts[1:])), "array<int>"), F.col("length").cast("int"))).cast("int"))
    counts = sorted((int(r["length"]), int(r["salt"]), int(r["count"])) for r in salted.groupBy("length", "salt").count().collect())
    # The first rank of each salt, and the runs, as sorted arrays: piece -> salt's first rank -> run is two binary searches.
    group_key = np.array([length * _RANK + salt for length, salt, _ in counts], np.int64)
    first, done = [], {}
    for length, _, n in counts:
        first.append(done.get(length, 0))
        done[length] = first[-1] + n
    group_first = np.array(first, np.int64)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    run_key = table[:, 0] * _RANK + table[:, 1]
    numbered = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*others)) - 1)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length = f["length"].to_numpy(np.int64)
            rank = group_first[np.searchsorted(group_key, length * _RANK + f["salt"].to_numpy(np.int64))] + f["rank"].to_numpy(np.int64)
            at = np.searchsorted(run_key, length * _RANK + rank, "right") - 1
            yield f.drop(columns=["salt", "rank"]).assign(sequence_id=table[at, 3] + rank - table[at, 1], offset=table[at, 4])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return numbered.mapInPandas(fill, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, spark: SparkSession, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each document."""
    scratch = Scratch(spark, "packing")
    with batches_of(spark):
        pieces = scratch.table(cut_pieces(docs, tokenizer, end_id, capacity), "pieces")
    return place(pieces, capacity, shuffle_partitions(spark))
