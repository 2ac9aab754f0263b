"""Line dedup (operator 10): an exact set-similarity join of lines, and the removal of later matches.

A line's tokens are its five-word shingles (words are runs of letters and digits, in lower case), as a set of 64-bit hashes. Two lines
match if the Jaccard similarity of their sets is 0.8 or more. A line is removed if any earlier line matches it, earlier by (doc_id,
place in the document); that is a property of the pair, so the order of the work doesn't matter. A line of one to four words is one
token of its whole sequence, so that it matches equal ones alone; with short=False such lines stay. Lines without words stay.

1. A pass over the texts gives every line's set as one 64-bit key, and counts tokens in 65,536 buckets over the whole corpus.
2. The counts order tokens by rarity (a class by count, then the hash); any one order makes the prefix filter exact. Prefix postings meet by
   token, where the length and positional filters and bitmaps leave candidate edges (see set_join), whose components hold every match.
3. The sets of candidates go out once for each task that meets them, with their places, dealt by component. An inverted index counts what
   a set shares with those before it, and each line keeps its earliest match, so a family of like lines leaves one row for each line,
   not its pairs. Which lines are candidates is broadcast if they are few, else it is joined.
4. Equal sets need no comparison: a key's first occurrence stands for it, and later ones go. What goes is collected by document and
   joined with the texts.

Skew: copies of a line are reduced in each task before any shuffle; a token of very many lines and a large component are dealt in blocks;
joins by key are plain shuffled joins that adaptive execution splits.

Defined results. Null text has no lines and stays null. Rows that agree in doc_id and text count as one document: they lose
the same lines. Null doc_ids come last. An empty table gives no rows. Extra columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietframe.llm.common import Scratch, column_bytes, mix64, owned_shingles, shingle_hashes, shuffle_partitions, slices, unique_rows, whole_groups, word_hashes, word_spans
from quietframe.llm.set_join import COUNTERS, TOKEN_BITS, Index, by_blocks, dealt_candidates, in_passes, packed_postings, parity, prefix_edges, prefixes, rarity_classes, share, union, unseen

WIDTH = 5
_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SAME = np.arange(256, dtype=np.uint8)
_TOKEN = np.uint64((1 << TOKEN_BITS) - 1)


def line_tokens(column: pa.Array, classes: np.ndarray | None = None, most: int = 1 << 19, short: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, line, n, first, tokens, order, keys, whole) of the lines that have tokens, some at a time. whole(i): the set of line i, 64-bit hashes that
    ascend; keys: one hash of each set. tokens[first[i] : first[i] + n[i]] are the first 40 bits of line i's, for the order of postings, each once, by rarity
    class and then hash; order: class and hash in one number. short: lines of fewer than WIDTH words have one token."""
    buf, offsets = column_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    if not len(buf):
        return
    breaks = np.flatnonzero(buf == 10)
    begins = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begins = begins[begins < len(buf)]
    starts, ends = word_spans(buf, begins, _NOT_WORD)
    if len(starts) < (1 if short else WIDTH):
        return
    words = word_hashes(buf, starts, ends, _SAME)
    line = np.searchsorted(begins, starts, "right") - 1
    if short:
        line, hashes = owned_shingles(words, line, WIDTH)
    else:
        whole = line[WIDTH - 1 :] == line[: -(WIDTH - 1)]
        hashes = shingle_hashes(words, WIDTH)[whole]
        line = line[: -(WIDTH - 1)][whole]
    if not len(line):
        return
    # Which row a line is in, and its place there: line feeds of its row before it.
    row_of = np.searchsorted(offsets, begins, "right") - 1
    feeds = np.searchsorted(breaks, begins)
    place_of = feeds - np.searchsorted(breaks, offsets)[row_of]
    new = np.empty(len(line), bool)
    new[0] = True
    np.not_equal(line[1:], line[:-1], out=new[1:])
    cut = np.flatnonzero(new)
    for a in range(0, len(cut), most):
        lo, hi = cut[a], cut[a + most] if a + most < len(cut) else len(line)
        number = np.cumsum(new[lo:hi]) - 1
        full = hashes[lo:hi]
        own = full >> np.uint64(64 - TOKEN_BITS)
        packed = number.astype(np.uint64) << np.uint64(44) | own
        if classes is not None:
            packed |= classes[(own >> np.uint64(TOKEN_BITS - 16)).astype(np.int64)].astype(np.uint64) << np.uint64(40)
        packed.sort()
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
        number = (packed >> np.uint64(44)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        n = np.diff(np.append(first, len(number)))
        begin = cut[a : a + most] - lo
        which, bounds = line[lo:hi][begin], np.append(begin, hi - lo)
        whole_set = lambda i, full=full, bounds=bounds: np.unique(full[bounds[i] : bounds[i + 1]])
        yield row_of[which], place_of[which], n, first, packed & _TOKEN, packed & np.uint64((1 << 44) - 1), set_keys(n, full, bounds, whole_set), whole_set


def set_keys(n: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, whole_set) -> np.ndarray:
    """One hash for each line's set of 64-bit hashes, the same in any order; hashes: as they stand in the lines, with repeats."""
    total = np.add.reduceat(mix64(hashes), bounds[:-1])
    for i in np.flatnonzero(np.diff(bounds) != n).tolist():
        total[i] = mix64(whole_set(i)).sum(dtype=np.uint64)
    return mix64(total * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64)).view(np.int64)


def scan_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """Pass 1. Short lines count here alone: they match equal keys only, which need no comparison. count null: a line (ord, uid, line, key, n
    tokens). Else a counter: key has its number and count its tokens."""
    schema = pa.schema([("ord", pa.int64()), ("uid", pa.int64()), ("line", pa.int32()), ("key", pa.int64()), ("n", pa.int32()), ("count", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                ord_, uid = part.column(0).to_numpy(), part.column(1).to_numpy()
                for row, line, n, first, tokens, _, keys, _ in line_tokens(part.column(2), short=short):
                    counts += np.bincount((tokens >> np.uint64(TOKEN_BITS - 16)).astype(np.int64), minlength=COUNTERS)
                    yield pa.RecordBatch.from_arrays([pa.array(ord_[row]), pa.array(uid[row]), pa.array(line.astype(np.int32)), pa.array(keys), pa.array(n.astype(np.int32)), pa.nulls(len(row), pa.int64())], schema=schema)
        some = np.flatnonzero(counts)
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none.cast(pa.int32()), pa.array(some), none.cast(pa.int32()), pa.array(counts[some])], schema=schema)

    return docs.mapInArrow(scan, "ord long, uid long, line int, key long, n int, count long")


def postings(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """Pass 2: the prefix of every line, each line of a task about once: packed (packed_postings), key, mark (parity). Sets of up to three
    tokens match equal ones alone, and have none."""
    schema = pa.schema([("packed", pa.int64()), ("key", pa.int64()), ("mark", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                for _, _, n, first, tokens, order, keys, _ in line_tokens(part.column(2), classes):
                    once = unseen(keys, seen) & (n > 3)
                    owner, within = prefixes(n, first)
                    owner, within = owner[once[owner]], within[once[owner]]
                    packed = packed_postings(order[first[owner] + within], within, n[owner])
                    yield pa.RecordBatch.from_arrays([pa.array(packed), pa.array(keys[owner]), pa.array(parity(tokens, first)[owner])], schema=schema)

    return docs.mapInArrow(emit, "packed long, key long, mark long")


_SET = pa.schema([("key", pa.int64()), ("label", pa.int64()), ("blocks", pa.int32()), ("ord", pa.int64()), ("uid", pa.int64()), ("line", pa.int32()), ("hashes", pa.binary())])
_SET_DDL = "key long, label long, blocks int, ord long, uid long, line int, hashes binary"


def sets_by_lookup(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """Pass 3 where candidates are few: their keys, labels and blocks are broadcast. Each task emits a candidate's set with the earliest place
    that it has met, again if an earlier one comes, so that the earliest of all is among them."""
    rows = dealt.toPandas().sort_values("key")
    sent = dealt.sparkSession.sparkContext.broadcast([rows[c].to_numpy() for c in ("key", "label", "blocks")])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, label, blocks = sent.value
        best: dict[int, tuple] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                ord_, uid = part.column(0).to_numpy(), part.column(1).to_numpy()
                for row, line, _, _, _, _, keys, whole_set in line_tokens(part.column(2)):
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    out = []
                    for i in np.flatnonzero(known[at] == keys).tolist():
                        place, k = (ord_[row[i]], uid[row[i]], line[i]), int(keys[i])
                        if k not in best or place < best[k]:
                            best[k] = place
                            out.append(i)
                    if len(best) > 200_000:
                        best.clear()
                    for a in range(0, len(out), 4096):
                        i = np.array(out[a : a + 4096])
                        sets = [whole_set(x).astype("<u8").tobytes() for x in i.tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(label[at[i]]), pa.array(blocks[at[i]]), pa.array(ord_[row[i]]), pa.array(uid[row[i]]), pa.array(line[i].astype(np.int32)), pa.array(sets, pa.binary())], schema=_SET)

    return docs.mapInArrow(emit, _SET_DDL)


def sets_by_join(docs: DataFrame, dealt: DataFrame, firsts: DataFrame) -> DataFrame:
    """Pass 3 where candidates are many: documents are joined with the candidates whose first line they hold."""
    wanted = dealt.join(firsts.select("key", "first"), "key").select("first.ord", "first.uid", F.struct(F.col("first.line").alias("line"), "key", "label", "blocks").alias("own"))
    held = docs.join(wanted.groupBy("ord", "uid").agg(F.sort_array(F.collect_list("own")).alias("own")), ["ord", "uid"]).select("ord", "uid", "text", "own")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ord_, uid, own = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(3).to_pylist()
                asked = [{x["line"]: x for x in some} for some in own]
                for row, line, _, _, _, _, keys, whole_set in line_tokens(part.column(2)):
                    out = [(i, x) for i, (r, k, key) in enumerate(zip(row.tolist(), line.tolist(), keys.tolist(), strict=True)) if (x := asked[r].get(k)) and x["key"] == key]
                    for a in range(0, len(out), 4096):
                        rows = [(x["key"], x["label"], x["blocks"], ord_[row[i]], uid[row[i]], x["line"], whole_set(i).astype("<u8").tobytes()) for i, x in out[a : a + 4096]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SET.types, strict=True)], schema=_SET)

    return held.mapInArrow(emit, _SET_DDL)


_MATCH = pa.schema([("key", pa.int64()), ("ord", pa.int64()), ("uid", pa.int64()), ("line", pa.int32()), ("similarity", pa.float64())])


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sets sorted by group: each set's earliest match among those of its group that come before it."""
    for group, key, side, ord_, uid, line, blobs in whole_groups(batches, 7):
        cut = np.flatnonzero(group[1:] != group[:-1]) + 1
        out: list[tuple] = []
        for s, e in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(group)]]).tolist(), strict=True):
            at = s + np.lexsort((line[s:e], uid[s:e], ord_[s:e]))
            at = at[np.sort(np.unique(key[at], return_index=True)[1])]  # each key at its earliest place, in order of place
            if len(at) < 2:
                continue
            index = Index([np.frombuffer(blobs[i], "<u8") for i in at], side[at].astype(np.int64))
            for j in range(1, len(at)):
                i, both = index.earliest(j)
                if i >= 0:
                    r = at[i]
                    out.append((key[at[j]], ord_[r], uid[r], line[r], both / (index.n[i] + index.n[j] - both)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _MATCH.types, strict=True)], schema=_MATCH)


def removed_lines(docs: DataFrame, scratch: Scratch, partitions: int, short: bool = False, block: int = 20_000, tokens: int = 1 << 20, most: int = 4_000, lookup: int = 1 << 20, at_once: int | None = None) -> DataFrame:
    """ord, uid, line, by_ord, by_line, similarity of every line that goes, with its earliest match. docs: ord, uid, text. block: postings of a token
    that one task compares; tokens and most: tokens and sets of a block, of which a task compares two; lookup: how many candidates are broadcast;
    at_once: bytes that go out in one pass."""
    scanned = scratch.table(scan_lines(docs, short), "scan")
    lines = scanned.filter("count IS NULL").drop("count")
    counts = np.zeros(COUNTERS, np.int64)
    for r in scanned.filter("count IS NOT NULL").groupBy("key").agg(F.sum("count").alias("n")).collect():
        counts[r["key"]] = r["n"]
    place = F.struct("ord", "uid", "line")
    firsts = lines.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"))
    at_once = at_once or share(int(counts.sum()))
    edges = prefix_edges(postings(docs, rarity_classes(counts)), scratch, partitions, block, at_once)

    def sets_of(rows: DataFrame, name: str = "") -> DataFrame:
        few = 0 < rows.limit(lookup + 1).count() <= lookup
        return sets_by_lookup(docs, rows) if few else sets_by_join(docs, rows, firsts)

    dealt = dealt_candidates(edges, firsts.select("key", "n"), sets_of, scratch, partitions, block, tokens, most, at_once)
    scratch.drop("candidates", "more_candidates*", "marks", "met", "meetings")
    matches = []
    for k, (some, own) in enumerate(in_passes(dealt, 8 * F.col("n").cast("bigint"), at_once)):
        sets = by_blocks(sets_of(some), "ord", "uid", "line", "hashes").filter(own).repartition(partitions, "group").sortWithinPartitions("group")
        matches.append(scratch.table(sets.mapInArrow(_matches, "key long, ord long, uid long, line int, similarity double"), f"matches{k}"))
    earliest = union(matches).groupBy("key").agg(F.min(F.struct("ord", "uid", "line", "similarity")).alias("match"))
    verdict = firsts.join(earliest, "key", "left").filter("rows > 1 OR match IS NOT NULL")
    own = F.struct(F.col("first.ord").alias("ord"), F.col("first.uid").alias("uid"), F.col("first.line").alias("line"), F.lit(1.0).alias("similarity"))
    verdict = scratch.table(verdict.select("key", F.least(own, F.coalesce("match", own)).alias("by")), "verdict")
    gone = lines.join(verdict.hint("merge"), "key").filter(place > F.struct("by.ord", "by.uid", "by.line"))
    return gone.select("ord", "uid", "line", F.col("by.ord").alias("by_ord"), F.col("by.line").alias("by_line"), F.col("by.similarity").alias("similarity"))


def dedup_lines(docs: DataFrame, spark: SparkSession, removed: str = "lines_removed", short: bool = False, **limits: int) -> DataFrame:
    """docs with the lines that go taken out of text, and `removed`: how many those were; a column of docs with that name gives way to it. short:
    equal lines of one to four words go too. limits: of removed_lines; they change the work, not the result."""
    scratch, partitions = Scratch(spark, "lines"), shuffle_partitions(spark)
    docs = docs.drop(removed)
    name = unique_rows(spark, ["ord", "uid", "gone"], [*docs.columns, removed])
    ord_ = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    uid = F.xxhash64("doc_id", "text")
    text = docs.select(ord_.alias("ord"), uid.alias("uid"), F.col("text").cast("string").alias("text"))
    lost = removed_lines(text, scratch, partitions, short=short, **limits).groupBy("ord", "uid").agg(F.collect_set("line").alias("gone"))
    lost = scratch.table(lost, "lost").select(F.col("ord").alias(name["ord"]), F.col("uid").alias(name["uid"]), F.col("gone").alias(name["gone"]))
    both = docs.withColumn(name["ord"], ord_).withColumn(name["uid"], uid).join(lost, [name["ord"], name["uid"]], "left")
    gone = F.col(name["gone"])
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    columns = [F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return both.select(*columns, F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias(removed))
