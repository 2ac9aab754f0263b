"""What the two exact set joins share (lines in line_dedup, documents in set_dedup).

Sets of n and m tokens with Jaccard similarity t or more share a token among the first n - ceil(t n) + 1 of each, in one order of all tokens.
Postings of those tokens meet by token. Under each, the length and positional filters and a parity bitmap rule pairs out, and what is left
is kept as edges of a spanning forest, never as all pairs. The components of these candidate edges hold every link. Their sets are dealt by
component to be compared exactly, a large component in blocks: every pair of blocks is a task's work of its own, of bounded size.

64 slots say little of a large set, so in a large corpus chance meetings under common tokens make one component of most large sets, and dealing
it in blocks would take the square of its size. The edges of a component of more than one block are therefore drawn again first: where its sets met,
they meet once more with bitmaps that have a slot for every token (wide_parity), which lose nothing either, and only what is left is dealt.

A token with more than `block` postings isn't searched where it was met: it is written down, and in a second round its postings are dealt in
blocks, every pair of blocks to a group of its own.

Whole sets take about twice the corpus's Parquet files, and in blocks they go out several times. What is dealt therefore goes out in passes, every group
in one of them: as many as it takes that a pass has a third of the bytes of all sets at most, so that disk follows the input, whatever is alike in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietframe.llm.common import Scratch, capped_groups, mix64, whole_groups

THRESHOLD = 0.8
TOKEN_BITS = 40
COUNTERS = 1 << 16
#: Fingerprints of sets of over SMALL tokens together must be within RADIUS bits, where postings carry them.
RADIUS, SMALL = 20, 100
#: Bytes that a pass may have in any case, and bytes of a posting.
AT_ONCE, POSTING = 1 << 28, 32
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64())])


def needed(n, t: float = THRESHOLD):
    """ceil(t n) for whole numbers, safe against rounding."""
    return np.ceil(np.asarray(n) * t - 1e-9).astype(np.int64)


def overlap(n):
    """What two sets of n tokens together must share to have similarity THRESHOLD."""
    return needed(n, THRESHOLD / (1 + THRESHOLD))


def prefixes(n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every set's first n - ceil(t n) + 1 tokens, the set and the place among the tokens."""
    size = n - needed(n) + 1
    owner = np.repeat(np.arange(len(n)), size)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return owner, within


def rarity_classes(counts: np.ndarray) -> np.ndarray:
    """Of each counter 0 to 15 (4 bits), by how far it stands over the middle."""
    middle = max(1.0, float(np.median(counts)))
    return np.clip(np.floor(8 * np.log2(np.maximum(counts, 1) / middle)) + 1, 0, 15).astype(np.uint8)


def packed_postings(order: np.ndarray, within: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Token (44 bits), place in the prefix (8 bits, 255 for more) and size (12 bits, 4095 for more) in one number."""
    return (order << np.uint64(20) | (np.minimum(within, 255) << 12 | np.minimum(n, 4095)).astype(np.uint64)).view(np.int64)


def parity(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A bitmap of each set: of 64 slots whether an odd number of tokens fall in it. Bits in which two differ are tokens that one has alone."""
    return np.bitwise_xor.reduceat(np.uint64(1) << (mix64(hashes) >> np.uint64(58)), first).view(np.int64)


def wide_parity(tokens: np.ndarray) -> bytes:
    """As parity, of one set, with as many slots as it has tokens or up to twice as many: a power of two, 64 at least. The half of one with twice the
    slots, folded on the other half, is the one with half of them."""
    slots = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((mix64(tokens) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def wide_marks(sets: DataFrame) -> DataFrame:
    """key, n, wide (wide_parity) of sets (key, hashes), each once."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("wide", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x, "<u8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in tokens], pa.int32()), pa.array([wide_parity(x) for x in tokens], pa.binary())], schema=schema)

    return sets.select("key", "hashes").mapInArrow(emit, "key long, n int, wide binary").dropDuplicates(["key"])


def unseen(keys: np.ndarray, seen: set[int]) -> np.ndarray:
    """The first of each key that isn't in seen, which takes them in and is emptied where it grows large."""
    out = np.zeros(len(keys), bool)
    _, at = np.unique(keys, return_index=True)
    out[at] = [k not in seen for k in keys[at].tolist()]
    seen.update(keys[at].tolist())
    if len(seen) > 200_000:
        seen.clear()
    return out


class Postings:
    """Postings of some rows; may(i, j): whether the sets of rows i and j can match with the token as their first common one. Sizes of 4095 and
    places of 255 stand for more, and then nothing is ruled out by them."""

    def __init__(self, cols: list[np.ndarray], side: np.ndarray | None = None):
        packed, self.key, mark, *fp = cols
        packed = packed.view(np.uint64)
        self.token, self.mark, self.fp = packed >> np.uint64(20), mark.view(np.uint64), fp[0].view(np.uint64) if fp else None
        self.place, self.n = (packed >> np.uint64(12) & np.uint64(255)).astype(np.int64), (packed & np.uint64(4095)).astype(np.int64)
        self.side = side

    def may(self, i, j):
        total = self.n[i] + self.n[j]
        could = np.minimum(np.minimum(self.n[i] - self.place[i], self.n[j] - self.place[j]), (total - np.bitwise_count(self.mark[i] ^ self.mark[j]).astype(np.int64)) // 2)
        fits = (could >= overlap(total)) | (self.n[i] >= 4095) | (self.n[j] >= 4095)
        if self.fp is not None:
            fits &= (total <= SMALL) | (np.bitwise_count(self.fp[i] ^ self.fp[j]) <= RADIUS)
        return fits if self.side is None else fits & ((self.side[i] < 0) | (self.side[i] != self.side[j]))


class Marks:
    """Wide bitmaps of some sets; may(x, left): which of left can match set x."""

    def __init__(self, n: np.ndarray, side: np.ndarray, wide: np.ndarray):
        self.n, self.side = n.astype(np.int64), side
        self.size, self.at, self.rows = np.array([len(x) for x in wide]), np.zeros(len(n), np.int64), {}
        for size in np.unique(self.size).tolist():
            which = np.flatnonzero(self.size == size)
            self.at[which] = np.arange(len(which))
            self.rows[size] = np.frombuffer(b"".join(wide[which].tolist()), "<u8").reshape(len(which), -1)

    def may(self, x: int, left: np.ndarray) -> np.ndarray:
        out, size = np.zeros(len(left), bool), int(self.size[x])
        own = self.rows[size][self.at[x]]
        # Sets that match have sizes within a factor of 1.25, so bitmaps of one length or of the next.
        for other in (size // 2, size, size * 2):
            some = np.flatnonzero(self.size[left] == other)
            if not len(some):
                continue
            mine, theirs = own, self.rows[other][self.at[left[some]]]
            if other < size:
                mine = mine[: len(mine) // 2] ^ mine[len(mine) // 2 :]
            elif other > size:
                theirs = theirs[:, : len(mine)] ^ theirs[:, len(mine) :]
            n, total = self.n[left[some]], self.n[left[some]] + self.n[x]
            differ = np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64)
            out[some] = np.minimum(np.minimum(n, self.n[x]), (total - differ) // 2) >= overlap(total)
        return out & ((self.side[left] != self.side[x]) | (self.side[x] < 0))


def forest(size: int, linked) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest, found breadth-first; linked(x, left): which of left link with x."""
    left, out = np.arange(size), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = linked(x, left)
            if hit.any():
                new = left[hit]
                out.append((np.full(len(new), x), new))
                queue.extend(new.tolist())
                left = left[~hit]
    return out


def edge_rows(a: list[np.ndarray], b: list[np.ndarray], token: list[np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Edges, each once; token: under which they were found."""
    if a and len(x := np.concatenate(a)):
        y = np.concatenate(b)
        rows = [np.minimum(x, y), np.maximum(x, y), *([] if token is None else [np.concatenate(token).view(np.int64)])]
        rows = np.unique(np.stack(rows), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], schema=pa.schema(list(_EDGE)[: len(rows)]))


def token_edges(group: np.ndarray, post: Postings, few: int = 12) -> Iterator[pa.RecordBatch]:
    """Edges (a, b, token) that keep what possibly matches within each group (numbers that stand together) connected."""
    cut = np.flatnonzero(group[1:] != group[:-1]) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(group)]])
    size = ends - starts
    small = np.repeat(size <= few, size)
    a, b, token = [], [], []
    for d in range(1, few):
        i = np.flatnonzero((group[d:] == group[:-d]) & small[d:] & (post.key[d:] != post.key[:-d]))
        i = i[post.may(i, i + d)]
        a.append(post.key[i])
        b.append(post.key[i + d])
        token.append(post.token[i])
    for s, e in zip(starts[size > few].tolist(), ends[size > few].tolist(), strict=True):
        at = s + np.unique(post.key[s:e], return_index=True)[1]  # equal keys are one set
        for x, y in forest(len(at), lambda x, left, at=at: post.may(at[x], at[left])):
            a.append(post.key[at[x]])
            b.append(post.key[at[y]])
            token.append(post.token[at[x]])
    yield from edge_rows(a, b, token)


def share(tokens: int) -> int:
    """How many bytes a pass may have where all sets have so many tokens."""
    return max(AT_ONCE, 8 * tokens // 3)


def in_passes(rows: DataFrame, size: Column, at_once: int) -> Iterator[tuple[DataFrame, Column]]:
    """For each pass, the rows (key, label, blocks and more) that have a group in it, and which groups of by_blocks() are its own. size: a row's bytes
    each time that it goes out; a pass has about `at_once` bytes."""
    count = -(-int(rows.agg(F.sum(size.cast("bigint") * F.col("blocks"))).first()[0] or 0) // at_once)
    if count <= 1:
        yield rows, F.lit(True)
        return
    i = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.pmod(F.xxhash64("label", F.least(i, j), F.greatest(i, j)), F.lit(count)))
    for k in range(count):
        yield rows.filter(F.array_contains(groups, F.lit(k).cast("bigint"))), F.pmod("group", F.lit(count)) == k


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def prefix_edges(post: DataFrame, scratch: Scratch, partitions: int, block: int, at_once: int) -> DataFrame:
    """Candidate edges (a, b, token) from postings: packed, key, mark and, if they have it, fp."""
    carried = post.columns

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in capped_groups(batches, len(carried), 20, block):
            if isinstance(got, tuple):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([got[0]], pa.int64()), pa.array([got[1]], pa.int64())], names=["a", "b", "token", "rows"])
                continue
            rows = Postings(got)
            for edges in token_edges(rows.token, rows):
                yield pa.RecordBatch.from_arrays([*edges.columns, pa.nulls(edges.num_rows, pa.int64())], names=["a", "b", "token", "rows"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, side, *cols in whole_groups(batches, 2 + len(carried)):
            yield from token_edges(group, Postings(cols, side))

    own = F.shiftright("packed", 20)
    found = scratch.table(post.repartition(partitions, own).sortWithinPartitions("packed").mapInArrow(first, "a long, b long, token long, rows long"), "candidates")
    edges = found.filter("b IS NOT NULL").select("a", "b", "token")
    large = found.filter("b IS NULL").select(F.col("token").alias("label"), "rows", F.ceil(F.col("rows") / block).cast("int").alias("blocks"))
    if large.isEmpty():
        return edges
    large = scratch.table(large, "large")
    volume = large.agg(F.sum(F.col("rows") * F.col("blocks"))).first()[0] * POSTING
    count = max(1, -(-volume // at_once))
    more = []
    for k in range(count):
        dealt = by_blocks(post.join(large, own == F.col("label")), *(c for c in carried if c != "key")).filter(F.pmod("group", F.lit(count)) == k)
        dealt = dealt.select("group", "side", *carried).repartition(partitions, "group").sortWithinPartitions("group")
        more.append(scratch.table(dealt.mapInArrow(second, "a long, b long, token long"), f"more_candidates{k}"))
    return union([edges, *more])


class Index:
    """Which of some sets have a token; linked() counts what a set shares with those that are left."""

    def __init__(self, sets: list[np.ndarray], side: np.ndarray):
        self.sets, self.side = sets, side
        self.n = np.array([len(x) for x in sets], np.int64)
        self.build(np.arange(len(sets)))

    def build(self, which: np.ndarray) -> None:
        tokens, owner = np.concatenate([self.sets[i] for i in which]), np.repeat(which, self.n[which])
        by = np.argsort(tokens, kind="stable")
        self.tokens, self.owner, self.held = tokens[by], owner[by], len(which)

    def shared(self, x: int) -> np.ndarray:
        """How many tokens each set shares with set x, as far as the index holds it."""
        lo, hi = np.searchsorted(self.tokens, self.sets[x], "left"), np.searchsorted(self.tokens, self.sets[x], "right")
        lo, size = lo[hi > lo], (hi - lo)[hi > lo]
        at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        return np.bincount(self.owner[at], minlength=len(self.sets))

    def earliest(self, x: int) -> tuple[int, int]:
        """The first of the sets before x that is similar to it, and how many tokens they share; -1 for none."""
        both = self.shared(x)[:x]
        ok = (both >= overlap(self.n[:x] + self.n[x])) & ((self.side[:x] != self.side[x]) | (self.side[x] < 0))
        i = int(ok.argmax()) if len(ok) else 0
        return (i, int(both[i])) if len(ok) and ok[i] else (-1, 0)

    def linked(self, x: int, left: np.ndarray) -> np.ndarray:
        if 2 * len(left) < self.held:
            self.build(left)
        both = self.shared(x)[left]
        ok = both >= overlap(self.n[left] + self.n[x])
        # Of two blocks only links over the cut count: those within a block are another task's.
        return ok & ((self.side[left] != self.side[x]) | (self.side[x] < 0))


def _dealt(edges: DataFrame, sizes: DataFrame, scratch: Scratch, name: str, tokens: int, most: int) -> DataFrame:
    from quietframe.llm.simhash import components

    labels = scratch.table(components(edges, scratch), f"{name}_labels")
    # components() has every node but the label itself.
    every = labels.unionByName(labels.select(F.col("label").alias("node"), "label")).distinct().withColumnRenamed("node", "key")
    every = scratch.table(every.join(sizes, "key"), f"{name}_wanted")
    blocks = every.groupBy("label").agg(F.ceil(F.greatest(F.sum("n") / tokens, F.count(F.lit(1)) / most)).cast("int").alias("blocks"))
    return scratch.table(every.join(blocks, "label").select("key", "label", "blocks", "n"), f"{name}_dealt")


def _met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by group: edges that keep what can match by wide bitmaps connected within each group."""
    for group, key, side, n, wide in whole_groups(batches, 5):
        cut = np.flatnonzero(group[1:] != group[:-1]) + 1
        a, b = [], []
        for s, e in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(group)]]).tolist(), strict=True):
            if e - s > 1:
                for x, y in forest(e - s, Marks(n[s:e], side[s:e], wide[s:e]).may):
                    a.append(key[s + x])
                    b.append(key[s + y])
        yield from edge_rows(a, b)


def dealt_candidates(edges: DataFrame, sizes: DataFrame, sets_of, scratch: Scratch, partitions: int, block: int, tokens: int, most: int, at_once: int) -> DataFrame:
    """key, label, blocks, n of every key in a candidate edge (a, b, token); label: its component; blocks: in how many a component is dealt, so that one
    has about `tokens` tokens and `most` sets at most. sizes: key, n of all sets; sets_of(rows, name): key, hashes of those with a row of key, label, blocks.

    A component of several blocks is drawn again: of each token that made an edge in it, the sets with such an edge are compared by wide bitmaps, in
    blocks of `block` sets. Sets that match met under their first common token, and each has an edge of that token there, so they meet again."""
    dealt = _dealt(edges, sizes, scratch, "candidate", tokens, most)
    large = dealt.filter("blocks > 1")
    if large.isEmpty():
        return dealt
    met = edges.join(large.select(F.col("key").alias("a")), "a").select(F.col("token").alias("label"), F.explode(F.array("a", "b")).alias("key"))
    met = scratch.table(met.distinct(), "met")
    blocks = met.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    marks = scratch.table(wide_marks(sets_of(large, "marked")), "marks")
    meetings = scratch.table(met.join(blocks, "label").join(marks.select("key", "n", F.length("wide").alias("bytes")), "key"), "meetings")
    drawn = []
    for k, (some, own) in enumerate(in_passes(meetings, F.col("bytes") + POSTING, at_once)):
        again = by_blocks(some.join(marks.select("key", "wide"), "key"), "n", "wide").filter(own)
        drawn.append(scratch.table(again.repartition(partitions, "group").sortWithinPartitions("group").mapInArrow(_met_again, "a long, b long"), f"met_again{k}"))
    again = union(drawn)
    return scratch.table(dealt.filter("blocks = 1").unionByName(_dealt(again, sizes, scratch, "again", tokens, most)), "dealt")


def by_blocks(sets: DataFrame, *carried: str) -> DataFrame:
    """group, key, side and what is carried, of sets (key, label, blocks): once for each pair of blocks that its block is in. side: -1 where the
    pair is one block, else which of the two."""
    sets = sets.withColumn("i", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j"))
    side = F.when(F.col("lo") == F.col("hi"), -1).otherwise((F.col("i") == F.col("hi")).cast("int")).cast("byte")
    return sets.select(F.xxhash64("label", "lo", "hi").alias("group"), "key", side.alias("side"), *carried)
