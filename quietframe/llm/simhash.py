"""SimHash near-dedup (operator 8) by Golay-code fuzzy hashing.

Fingerprints. A-Z lower-cased, words between ASCII white space, 3-word shingles with repeats, XXH64 (seed 42) of each; a bit of the
fingerprint is 1 if it is set in over half of the hashes. Texts of fewer words are one shingle; no words: fingerprint zero.

Candidates. Two fingerprints link if at most RADIUS = 3 of 64 bits differ. The bits are cut into three segments of 22, 21 and 21 bits,
each padded to a word of the perfect binary Golay code (23, 12, 7). Three errors over three segments leave two segments with at most
one error each. Every word has one codeword within distance 3; a word at distance 1 from it has that codeword within distance 4. So a
segment gives as keys the indices (12 bits) of all codewords within distance 4: six if its nearest is at distance 3, else one. Two
fingerprints that link share a pair of keys for some pair of segments, and one of them has its nearest codewords there. That is exact:
no link can be missed, and every candidate is verified on all 64 bits.

Groups. Only distinct fingerprints are joined, so copies that agree in all bits never meet. Rows with one key are streamed through a
task in key order. A key's fingerprints are searched breadth-first, each step comparing one fingerprint with those not yet reached in
numpy, and leave a spanning forest: at most one edge for each fingerprint, never all pairs. A key with more than `block` fingerprints
(a dense family at scale) is put off to a second round and dealt in blocks: every pair of blocks is a task's work of its own, of bounded size.

near_documents serves the pipeline, where fingerprints are of five-word shingles and the similarity of their sets decides, 0.8 or more.

Components come from the edges by rounds of label contraction (large-star and small-star) over written tables; labels, links and fingerprints
stay distributed, and only counts reach the driver.

Defined results. Null text is empty: fingerprint zero, which links like any other. Equal rows are in one component. An empty table has
no components. component_id is the smallest doc_id that is reachable; null doc_ids are in the component but never its id unless
alone. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietframe.llm.common import Scratch, capped_groups, shuffle_partitions, slices, text_or_empty, whole_groups

RADIUS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: a generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _parity() -> np.ndarray:
    """Of each 12-bit message, the 11 check bits."""
    x = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - 11)), x)
    return x


PARITY = _parity()


def syndrome(x: np.ndarray) -> np.ndarray:
    return (x & 0x7FF) ^ PARITY[x >> 11]


def _errors() -> np.ndarray:
    """Of each syndrome, the error patterns of weight 4 at most, the lightest first; -1 where there are fewer than six."""
    out = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        e = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        for s, x in zip(syndrome(e).tolist(), e.tolist(), strict=True):
            out[s, used[s]] = x
            used[s] += 1
    return out


ERRORS = _errors()


def segment_keys(prints: np.ndarray) -> list[np.ndarray]:
    """For each segment an array (fingerprints, 6) of codeword indices within distance 4, the nearest first, -1 for none."""
    out = []
    for at, width in SEGMENTS:
        x = ((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
        e = ERRORS[syndrome(x)]
        out.append(np.where(e < 0, -1, (x[:, None] ^ e) >> 11))
    return out


def shingle_prints(texts: list[bytes]) -> np.ndarray:
    """The fingerprints (uint64) of UTF-8 texts."""
    hashes, sizes = [], []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split()  # bytes: A-Z alone are lowered, and ASCII white space alone separates
        n = len(words)
        if n < 3:
            sizes.append(n > 0)
            if n:
                hashes.append(digest(b" ".join(words), 42))
            continue
        joined = b" ".join(words)
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1).tolist()
        starts = [0, *[e + 1 for e in ends[: n - 3]]]
        hashes.extend([digest(joined[a:b], 42) for a, b in zip(starts, ends[2:], strict=True)])
        sizes.append(n - 2)
    return majority(np.array(hashes, np.uint64), np.array(sizes, np.int64))


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits set in over half of each run of hashes. Eight bits are counted at a time, one in each byte of a word."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    first = np.cumsum(sizes) - sizes
    # Runs of at most 255, so that no byte overflows.
    parts = -(-sizes[full] // 255)
    owner = np.repeat(np.arange(len(full)), parts)
    at = first[full][owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    ones = np.uint64(0x0101010101010101)
    begin = np.cumsum(parts) - parts
    bits = np.zeros(len(full), np.uint64)
    for k in range(8):
        some = np.add.reduceat((hashes >> np.uint64(k)) & ones, at)
        counts = np.add.reduceat(some.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), begin, axis=0)
        for byte in range(8):
            bits |= (2 * counts[:, byte] > sizes[full]).astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = bits
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; a narrow pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prints = shingle_prints(part.column(1).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text")).mapInArrow(hashed, "doc_id long, fp long")


def keyed(prints: DataFrame) -> DataFrame:
    """key, fp, own for every key of every fingerprint; own: both codewords are the nearest ones."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("own", pa.bool_())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(i, 20_000).to_numpy()
                k = segment_keys(fp.view(np.uint64))
                for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
                    key = (k[a][:, :, None] << 12 | k[b][:, None, :]) | pair << 24
                    fine = ((k[a][:, :, None] >= 0) & (k[b][:, None, :] >= 0)).reshape(len(fp), 36)
                    own = np.zeros((len(fp), 36), bool)
                    own[:, 0] = True
                    row = np.repeat(np.arange(len(fp)), 36).reshape(len(fp), 36)[fine]
                    yield pa.RecordBatch.from_arrays([pa.array(key.reshape(len(fp), 36)[fine]), pa.array(fp[row]), pa.array(own[fine])], schema=schema)

    return prints.select("fp").mapInArrow(keys, "key long, fp long, own boolean")


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the fingerprints that link, found breadth-first without making pairs."""
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(fp[left], fp[x])
            if hit.any():
                new = left[hit]
                a.append(np.full(len(new), x))
                b.append(new)
                queue.extend(new.tolist())
                left = left[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def across(fp: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the two sides that keep all of their links' connections, at most one for each fingerprint of side 1 and each of its
    first partners: every fingerprint of either side takes part in at least one edge if it has a link over the cut, and components of
    the bipartite graph are spanned breadth-first."""
    sides = [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    a, b = [], []
    while len(sides[0]) and len(sides[1]):
        queue, sides[0] = [(0, sides[0][0])], sides[0][1:]
        while queue:
            s, x = queue.pop()
            other = sides[1 - s]
            hit = near(fp[other], fp[x])
            if hit.any():
                new = other[hit]
                a.append(np.full(len(new), x))
                b.append(new)
                queue.extend((1 - s, y) for y in new.tolist())
                sides[1 - s] = other[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def key_edges(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of rows key, fp, own and, where given, side, in order of key: the edges of each key's forest."""
    key, fp, own, side = cols if len(cols) == 4 else [*cols, None]
    fp = fp.view(np.uint64)
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
    size = ends - starts
    a, b = [], []
    # Small groups, all at once: neighbours at every distance within a group.
    small = np.repeat(size <= 12, size)
    for d in range(1, 12):
        same = np.flatnonzero((key[d:] == key[:-d]) & small[d:] & (own[d:] | own[:-d]))
        hit = same[near(fp[same], fp[same + d])]
        a.append(fp[hit])
        b.append(fp[hit + d])
    for s, e in zip(starts[size > 12].tolist(), ends[size > 12].tolist(), strict=True):
        x, y = forest(fp[s:e]) if side is None or side[s] < 0 else across(fp[s:e], side[s:e])
        a.append(fp[s:e][x])
        b.append(fp[s:e][y])
    a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
    if len(a):
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], schema=_EDGE)


def links(prints: DataFrame, scratch: Scratch, partitions: int, block: int = 50_000) -> DataFrame:
    """Edges (a, b) of fingerprints that keep every connection by links. A key of more than `block` fingerprints isn't searched where it was met:
    it is written down (b null), and in a second round it is dealt in blocks. The table of such keys is joined, never collected."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in capped_groups(batches, 3, 0, block):
            if isinstance(got, tuple):
                yield pa.RecordBatch.from_arrays([pa.array([got[0]], pa.int64()), pa.nulls(1, pa.int64()), pa.array([got[1]], pa.int64())], names=["a", "b", "rows"])
                continue
            for edges in key_edges(got):
                yield pa.RecordBatch.from_arrays([*edges.columns, pa.nulls(edges.num_rows, pa.int64())], names=["a", "b", "rows"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in whole_groups(batches, 4):
            yield from key_edges(got)

    keys = keyed(prints)
    found = scratch.table(keys.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(first, "a long, b long, rows long"), "edges")
    edges = found.filter("b IS NOT NULL").select("a", "b")
    large = found.filter("b IS NULL").select(F.col("a").alias("key"), F.ceil(F.col("rows") / block).cast("int").alias("n"))
    if large.isEmpty():
        return edges
    dealt = keys.join(scratch.table(large, "large"), "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    pairs = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = pairs.withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j"))
    side = F.when(F.col("lo") == F.col("hi"), -1).otherwise((F.col("i") == F.col("hi")).cast("int")).cast("byte")
    pairs = pairs.select(F.xxhash64("key", "lo", "hi").alias("key"), "fp", F.lit(True).alias("own"), side.alias("side"))
    more = pairs.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(second, "a long, b long")
    return edges.unionByName(scratch.table(more, "more_edges"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: the smallest node that each node of edges reaches, for every node in an edge. Alternates large-star and
    small-star until nothing changes; every round writes a table, and the driver sees two sums."""
    pairs = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc0")
    last, k = None, 0
    while True:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # Large star: larger neighbours join the least one.
        star = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours and the node itself join the least one.
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        star = star.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        k += 1
        pairs = scratch.table(star, f"cc{k}")
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"cc{k - 1}")
        if now == last:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
        last = now


def near_duplicates(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, fp (signed long), component_id of every row."""
    scratch, partitions = Scratch(spark, "simhash"), shuffle_partitions(spark)
    prints = scratch.table(fingerprints(docs), "prints")
    distinct = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    edges = links(distinct, scratch, partitions)
    labels = scratch.table(components(edges, scratch), "labels")
    # A component's id: the least first doc of its fingerprints. Fingerprints outside all links are their own component.
    with_label = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    with_label = scratch.table(with_label, "labelled")
    smallest = with_label.groupBy("label").agg(F.min("first").alias("component_id"))
    named = scratch.table(with_label.join(smallest, "label").select("fp", "component_id"), "named")
    return prints.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def near_documents(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, uid, copies: of each group of documents that link at a similarity of five-word shingles of 0.8 or more, the row with the smallest
    doc_id (null last), by doc_id and uid (a number for its doc_id and text); copies: how many rows of docs agree in both."""
    from quietframe.llm.set_dedup import near_duplicates as near_sets

    each = near_sets(docs, spark).groupBy("component", "doc_id", "uid").agg(F.count(F.lit(1)).alias("copies"))
    best = each.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "copies")).alias("best"))
    return Scratch(spark, "near").table(best.select("best.doc_id", "best.uid", "best.copies"), "best")


def hex_print(fp):
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
