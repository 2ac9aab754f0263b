"""Near-dedup of whole documents at a similarity of five-word shingles: how operator 8 serves the pipeline (simhash.near_documents).

A document's tokens are its five-word shingles (A-Z lower-cased, words between ASCII white space) as a set of 64-bit hashes; a document of
fewer words is one token of its whole sequence. Two documents link if the Jaccard similarity of their sets is 0.8 or more, and components
are what links reach.

1. A pass gives every document's set as one 64-bit key with its 64-bit SimHash, and counts tokens in 65,536 buckets over the corpus. Equal
   keys are one set.
2. Candidates come from two sides. Golay keys of the fingerprints (operator 8) give those within three bits. At similarity 0.8 fingerprints
   differ in 10 of 64 bits on average with a deviation of 3, which no choice of Golay keys reaches, so the rest come by prefixes: sets
   with similarity t or more share a token among the first n - ceil(t n) + 1 of each in one order of all tokens, rare ones first. Under each
   token the length and positional filters and a 64-bit parity bitmap rule pairs out, which loses nothing, and so does, for sets of over
   SMALL tokens together, a distance of over RADIUS = 20 bits of their fingerprints (a pair at the very threshold is over that with a
   probability of about 0.0001). What is left under a token is kept as a spanning forest, never as all pairs.
3. The candidates' components hold every link. The sets of their documents go out once for each task that meets them, dealt by component,
   and there an inverted index counts what two sets share: the exact check. A component of more than `tokens` tokens is dealt in blocks, and
   every pair of blocks is a task's work of its own, of bounded size. Groups go out in passes (see set_join). The exact links' spanning forest gives the components that count.

Skew. Copies are reduced to one set in each task before any shuffle. A token with more than `block` postings isn't compared where it was
met: it is named, and in a second round its postings are dealt in blocks, every pair of blocks to a group of its own.

Defined results. Null text is empty, and documents without words are equal. An empty table has no components. component_id is the
smallest doc_id that is reachable; null doc_ids are in the component but never its id unless alone. Rows that agree in doc_id and text
have one uid. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietframe.llm import simhash
from quietframe.llm.common import Scratch, column_bytes, mix64, owned_shingles, row_uid, shuffle_partitions, slices, text_or_empty, whole_groups, word_hashes, word_spans
from quietframe.llm.set_join import COUNTERS, TOKEN_BITS, Index, by_blocks, dealt_candidates, edge_rows, forest, in_passes, packed_postings, parity, prefix_edges, prefixes, rarity_classes, share, union, unseen

WIDTH = 5


def text_sets(column: pa.Array, classes: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row, n, first, hashes, order) of the texts that have words. hashes[first[i] : first[i] + n[i]] are text i's, each once, in order of
    rarity class and the hash's first 40 bits; order: both in one number. A column has fewer than 2 ** 20 rows (see slices)."""
    buf, offsets = column_bytes(column)
    starts, ends = word_spans(buf, offsets[:-1])
    row, hashes = owned_shingles(word_hashes(buf, starts, ends), np.searchsorted(offsets, starts, "right") - 1, WIDTH)
    order = hashes >> np.uint64(64 - TOKEN_BITS)
    if classes is not None:
        order |= classes[(hashes >> np.uint64(48)).astype(np.int64)].astype(np.uint64) << np.uint64(TOKEN_BITS)
    by = np.argsort(order | row.astype(np.uint64) << np.uint64(44))
    row, hashes, order = row[by], hashes[by], order[by]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes, order = row[once], hashes[once], order[once]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    return row[first], np.diff(np.append(first, len(row))), first, hashes, order


def set_keys(n: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One hash for each set, the same in any order. Zero is the empty set's."""
    return mix64(np.add.reduceat(mix64(hashes), first) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64)).view(np.int64) if len(n) else np.zeros(0, np.int64)


def scan_texts(docs: DataFrame) -> DataFrame:
    """Pass 1. count null: a document (doc_id, uid, key, n tokens, fp). Else a counter: key has its number and count its tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("count", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                row, n, first, hashes, _ = text_sets(part.column(2))
                counts += np.bincount((hashes >> np.uint64(48)).astype(np.int64), minlength=COUNTERS)
                keys, sizes, prints = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                keys[row], sizes[row], prints[row] = set_keys(n, first, hashes), n, simhash.majority(hashes, n).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys), pa.array(sizes), pa.array(prints), pa.nulls(len(keys), pa.int64())], schema=schema)
        some = np.flatnonzero(counts)
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(some), none, none, pa.array(counts[some])], schema=schema)

    return docs.mapInArrow(scan, "doc_id long, uid long, key long, n long, fp long, count long")


def postings(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """Pass 2: the prefix of every set, each set of a task about once: packed (packed_postings), key, mark (parity) and fp (the SimHash)."""
    schema = pa.schema([("packed", pa.int64()), ("key", pa.int64()), ("mark", pa.int64()), ("fp", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                _, n, first, hashes, order = text_sets(part.column(2), classes)
                if not len(n):
                    continue
                keys = set_keys(n, first, hashes)
                once = unseen(keys, seen)
                mark = parity(hashes, first)
                prints = simhash.majority(hashes, n).view(np.int64)
                owner, within = prefixes(n, first)
                owner, within = owner[once[owner]], within[once[owner]]
                packed = packed_postings(order[first[owner] + within], within, n[owner])
                yield pa.RecordBatch.from_arrays([pa.array(packed), pa.array(keys[owner]), pa.array(mark[owner]), pa.array(prints[owner])], schema=schema)

    return docs.mapInArrow(emit, "packed long, key long, mark long, fp long")


def print_edges(rows: DataFrame, scratch: Scratch, partitions: int) -> DataFrame:
    """Candidate edges (a, b, token) of keys whose fingerprints are within operator 8's radius, by Golay keys; token: a number of the edge's own."""
    prints = scratch.table(rows.filter("n > 0").groupBy("fp").agg(F.min("key").alias("rep"), F.min("doc_id").alias("first")), "prints")
    edges = simhash.links(prints.select("fp", "first"), scratch, partitions)
    left, right = prints.select(F.col("fp").alias("a"), F.col("rep").alias("rep_a")), prints.select(F.col("fp").alias("b"), F.col("rep").alias("rep_b"))
    across = edges.join(left, "a").join(right, "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    equal = rows.filter("n > 0").select("fp", "key").distinct().join(prints.select("fp", "rep"), "fp").filter("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    return across.unionByName(equal).withColumn("token", F.xxhash64("a", "b"))


def full_sets(docs: DataFrame) -> DataFrame:
    """Pass 3, of candidates' rows (text, wanted, label, blocks): wanted and the whole set, each set of a task about once."""
    schema = pa.schema([("key", pa.int64()), ("label", pa.int64()), ("blocks", pa.int32()), ("hashes", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                row, n, first, hashes, _ = text_sets(part.column(0))
                some = np.flatnonzero(set_keys(n, first, hashes) == part.column(1).to_numpy()[row])
                some = some[unseen(part.column(1).to_numpy()[row[some]], seen)]
                sets = [hashes[first[i] : first[i] + n[i]].tobytes() for i in some.tolist()]
                at = pa.array(row[some])
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(at) for k in (1, 2, 3)], pa.array(sets, pa.binary())], schema=schema)

    return docs.select("text", "wanted", "label", "blocks").mapInArrow(emit, "key long, label long, blocks int, hashes binary")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sets sorted by group, a spanning forest of each group's links."""
    for group, key, side, blobs in whole_groups(batches, 4):
        cut = np.flatnonzero(group[1:] != group[:-1]) + 1
        a, b = [], []
        for s, e in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(group)]]).tolist(), strict=True):
            at = s + np.unique(key[s:e], return_index=True)[1]
            if len(at) > 1:
                index = Index([np.frombuffer(blobs[i], "<u8") for i in at], side[at].astype(np.int64))
                for x, y in forest(len(at), index.linked):
                    a.append(key[at[x]])
                    b.append(key[at[y]])
        yield from edge_rows(a, b)


def exact_links(edges: DataFrame, rows: DataFrame, docs: DataFrame, scratch: Scratch, partitions: int, block: int, tokens: int, most: int, at_once: int) -> DataFrame:
    """Edges (a, b) of keys that link, enough to keep every connection by links, from candidate edges."""
    one = rows.groupBy("key").agg(F.min("uid").alias("own"), F.max("n").alias("n"))

    def sets_of(some: DataFrame, name: str) -> DataFrame:
        # Whose texts are read again: few rows are broadcast (Spark checks the written table's size), many are joined by a shuffle.
        some = scratch.table(some.join(one.select("key", "own"), "key").withColumnRenamed("key", "wanted"), name)
        return full_sets(docs.join(some, F.col("uid") == F.col("own")))

    dealt = dealt_candidates(edges, one, sets_of, scratch, partitions, block, tokens, most, at_once)
    scratch.drop("candidates", "more_candidates*", "edges", "more_edges", "marks", "met", "meetings")
    links = []
    for k, (some, own) in enumerate(in_passes(dealt, 8 * F.col("n").cast("bigint"), at_once)):
        sets = by_blocks(sets_of(some, f"owners{k}"), "hashes").filter(own)
        links.append(scratch.table(sets.repartition(partitions, "group").sortWithinPartitions("group").mapInArrow(_links, "a long, b long"), f"links{k}"))
    return union(links)


def near_duplicates(docs: DataFrame, spark: SparkSession, block: int = 20_000, tokens: int = 1 << 21, most: int = 4_000, at_once: int | None = None) -> DataFrame:
    """doc_id, uid, component_id and component (a number of its own) of every row. block: postings of a token that one task compares; tokens and
    most: tokens and sets of a block, of which a task compares two; at_once: bytes that go out in one pass."""
    scratch, partitions = Scratch(spark, "sets"), shuffle_partitions(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_uid().alias("uid"), text_or_empty().alias("text"))
    scanned = scratch.table(scan_texts(texts), "scan")
    counts = np.zeros(COUNTERS, np.int64)
    for r in scanned.filter("count IS NOT NULL").groupBy("key").agg(F.sum("count").alias("n")).collect():
        counts[r["key"]] = r["n"]
    rows = scanned.filter("count IS NULL").drop("count")
    at_once = at_once or share(int(counts.sum()))
    edges = prefix_edges(postings(texts, rarity_classes(counts)), scratch, partitions, block, at_once).unionByName(print_edges(rows, scratch, partitions))
    links = exact_links(edges, rows, texts, scratch, partitions, block, tokens, most, at_once)
    labels = scratch.table(simhash.components(links, scratch), "labels")
    distinct = rows.groupBy("key").agg(F.min("doc_id").alias("first"))
    labelled = scratch.table(distinct.join(labels, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("label", "key").alias("component")), "labelled")
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    named = scratch.table(labelled.join(smallest, "component").select("key", "component", "component_id"), "named")
    return rows.join(named.hint("merge"), "key").select("doc_id", "uid", "component_id", "component")

