"""Benchmark decontamination (operator 4): SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

Words are runs of letters and digits in lower case; shingles are five words, weighted by how often they occur. A window has as many words
as the benchmark item that it is held against (a shorter document is one window). A document is contaminated by an item if some
window's weighted Jaccard similarity with it, the sum of the lesser over the sum of the greater weights, is 0.8 or more.

1. Windows that share no shingle with any item have similarity zero and aren't looked at: a bit table and then a sorted array of the items'
   shingles find the places where a window can begin. That loses nothing.
2. Every such window has a 64-bit SimHash of its weighted shingles, made from running sums of bits. Items of its size are found by a
   multi-index: the fingerprint is cut into eight blocks, and two fingerprints within RADIUS = 20 bits agree to two bits in some
   block; each block's table lists, for every byte, the items within two bits of it. All pairs within the radius are found.
   (Windows with similarity 0.8 differ in 10 bits on average with a deviation of 3, so the radius is over three deviations beyond it.)
3. Pairs within the radius are compared exactly. The best window of each document and item is returned.

Items are a stated query set: they are taken in blocks of at most `block`, each shipped with its tables to the tasks (of bounded size),
and every block is held against all documents in a narrow pass. No shuffle, and nothing of a document reaches the driver.

An item of fewer than five words is one shingle: a window matches it if it is equal. Defined results. Null and empty texts, of documents
or items, match nothing. Repeated rows are reported each. Of equally good windows the first counts. Empty tables give no
rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietframe.llm.common import column_bytes, row_uid, shingle_hashes, slices, text_or_empty, word_hashes, word_spans
from quietframe.llm.line_dedup import _NOT_WORD, _SAME

WIDTH, THRESHOLD, RADIUS, BLOCKS = 5, 0.8, 20, 8
SCHEMA = "doc_id long, uid long, item_id long, similarity double, distance int, start_word long, words long"


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and where each row's begin (one more than rows)."""
    buf, offsets = column_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    starts, ends = word_spans(buf, offsets, _NOT_WORD)
    return word_hashes(buf, starts, ends, _SAME), np.searchsorted(starts, offsets)


def fingerprints(shingles: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SimHash of shingles[begin : begin + size] for every window; a bit is 1 if more of the weight has it than has not."""
    signs = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    total = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(signs, axis=0, out=total[1:])
    bits = (total[begin + size] - total[begin]) > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


class Items:
    """A block of benchmark items, by size: fingerprints, block tables and shingle counts."""

    def __init__(self, items: list[tuple[int, str | None]]):
        words, first = text_words(pa.array([t for _, t in items], pa.string()))
        self.sizes: dict[int, list[int]] = {}
        self.ids = [i for i, _ in items]
        self.bags: list[tuple[np.ndarray, np.ndarray]] = []
        prints = np.zeros(len(items), np.uint64)
        found: dict[int, list[np.ndarray]] = {}
        for k in range(len(items)):
            w = words[first[k] : first[k + 1]]
            width = min(WIDTH, len(w))
            sh = shingle_hashes(w, width) if width else np.zeros(0, np.uint64)
            self.bags.append(np.unique(sh, return_counts=True))
            if width:
                self.sizes.setdefault(len(w), []).append(k)
                prints[k] = fingerprints(sh, np.array([0]), np.array([len(sh)]))[0]
                found.setdefault(width, []).append(sh)
        self.prints = prints
        #: For each shingle width the sorted shingles, a table of 2^20 bits, and the item sizes of each shingle.
        self.shingles = {}
        for width, lists in found.items():
            all_ = np.unique(np.concatenate(lists))
            table = np.zeros(1 << 20, bool)
            table[(all_ >> np.uint64(44)).astype(np.int64)] = True
            self.shingles[width] = (all_, table)
        self.size_shingles = {n: np.unique(np.concatenate([self.bags[k][0] for k in ks])) for n, ks in self.sizes.items()}
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= RADIUS // BLOCKS
        #: For each size and block: [byte, item] is true if the item's byte there is within RADIUS // BLOCKS bits.
        self.tables = {n: [near[:, ((prints[ks] >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)] for b in range(BLOCKS)] for n, ks in self.sizes.items()}

    def hits(self, shingles: np.ndarray, width: int) -> np.ndarray:
        """Places of shingles that some item has."""
        all_, table = self.shingles[width]
        at = np.flatnonzero(table[(shingles >> np.uint64(44)).astype(np.int64)])
        pos = np.minimum(np.searchsorted(all_, shingles[at]), len(all_) - 1)
        return at[all_[pos] == shingles[at]]

    def near(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for all fingerprints of items of n words within RADIUS, by the block tables."""
        some = np.zeros((len(prints), len(self.sizes[n])), bool)
        for b, table in enumerate(self.tables[n]):
            some |= table[((prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)]
        window, item = np.nonzero(some)
        items = np.array(self.sizes[n])[item]
        close = np.bitwise_count(prints[window] ^ self.prints[items]) <= RADIUS
        return window[close], items[close]

    def near_in_runs(self, n: int, prints: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
        """near() for some windows at a time, so that windows times items stay under `most`."""
        step = max(1, most // len(self.sizes[n]))
        for i in range(0, len(prints), step):
            window, item = self.near(n, prints[i : i + step])
            yield from zip((window + i).tolist(), item.tolist(), strict=True)

    def similarity(self, shingles: np.ndarray, item: int) -> float:
        own, counts = self.bags[item]
        got, n = np.unique(shingles, return_counts=True)
        at = np.minimum(np.searchsorted(own, got), len(own) - 1)
        same = own[at] == got
        least = int(np.minimum(counts[at[same]], n[same]).sum())
        return least / (int(counts.sum()) + int(n.sum()) - least)

    def search(self, column: pa.Array) -> list[tuple[int, int, float, int, int, int]]:
        """(row, item, similarity, distance, first word, words) of the best window of every contaminated row and item."""
        words, first = text_words(column)
        best: dict[tuple[int, int], tuple] = {}
        for width in self.shingles:
            if len(words) < width:
                continue
            shingles = shingle_hashes(words, width)
            at = self.hits(shingles, width)
            row = np.searchsorted(first, at, "right") - 1
            inside = at + width <= first[row + 1]
            at, row = at[inside], row[inside]
            if not len(at):
                continue
            for n in (n for n in self.sizes if min(n, WIDTH) == width):
                own = self.size_shingles[n]
                pos = np.minimum(np.searchsorted(own, shingles[at]), len(own) - 1)
                ours = own[pos] == shingles[at]
                if not ours.any():
                    continue
                a, r = at[ours], row[ours]
                # A window of n words that holds the hit begins at most n - width words before it; none runs out of its row.
                low, high = np.maximum(a - (n - width), first[r]), np.minimum(a, first[r + 1] - n)
                low, high = np.minimum(low, np.maximum(high, first[r])), np.maximum(high, first[r])
                length = high - low + 1
                begin = np.repeat(low, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                begin = np.unique(begin)
                mine = np.searchsorted(first, begin, "right") - 1
                m = np.minimum(n, first[mine + 1] - begin) - width + 1
                # The shingles that these windows take, side by side: runs of places that windows cover.
                lo, hi = begin, begin + m
                new = np.concatenate([[True], lo[1:] > np.maximum.accumulate(hi)[:-1]])
                run = np.cumsum(new) - 1
                run_lo, run_hi = lo[new], np.maximum.reduceat(hi, np.flatnonzero(new))
                shift = np.cumsum(run_hi - run_lo) - (run_hi - run_lo)
                taken = np.repeat(run_lo - shift, run_hi - run_lo) + np.arange((run_hi - run_lo).sum())
                prints = fingerprints(shingles[taken], begin - run_lo[run] + shift[run], m)
                for w, k in self.near_in_runs(n, prints):
                    sim = self.similarity(shingles[begin[w] : begin[w] + m[w]], int(k))
                    if sim >= THRESHOLD:
                        key, d = (int(mine[w]), int(k)), int(np.bitwise_count(prints[w] ^ self.prints[k]))
                        if key not in best or sim > best[key][0]:
                            best[key] = (sim, d, int(begin[w] - first[mine[w]]), int(m[w] + width - 1))
        return [(*key, *found) for key, found in sorted(best.items())]


def search_block(docs: DataFrame, items: Items) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("distance", pa.int32()), ("start_word", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                found = items.search(part.column(1))
                if found:
                    ids, uids = part.column(0).to_pylist(), part.column(2).to_pylist()
                    rows = [(ids[r], uids[r], items.ids[k], *rest) for r, k, *rest in found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text"), row_uid().alias("uid")).mapInArrow(run, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, block: int = 5_000) -> DataFrame:
    """doc_id, uid (a number for its doc_id and text), item_id, similarity, distance, start_word, words: each row's best window for each item that it holds."""
    out, items = None, []

    def search() -> None:
        nonlocal out, items
        part = search_block(docs, Items(items))
        out, items = part if out is None else out.unionByName(part), []

    for r in benchmark.select(F.col("item_id").cast("bigint"), text_or_empty().alias("text")).toLocalIterator():
        items.append((r["item_id"], r["text"]))
        if len(items) == block:
            search()
    if items or out is None:
        search()
    return out
