"""Quality classifier (operator 2): importance resampling with hashed n-gram models and Gumbel top-k.

Two generative models of hashed word unigrams and bigrams: the target model counts the documents that a bounded sample of labels calls
good, the raw model counts every document. A document's importance weight is the ratio of the two models' likelihoods. Sampling k
documents without replacement in proportion to their weights is taking the k largest of (log weight + Gumbel noise); the noise comes
from a hash of doc_id, so a run can be repeated.

k. Unless a number is given, k is the number of documents whose log weight reaches a cut that is fitted on the labelled sample (the cut
that loses least, where losing a good document counts `care` times as much as keeping a bad one).

Words are runs of letters, digits and bytes over 0x7F, or runs of punctuation, so that junk marks are words of their own; A-Z are lowered.
The log weight is the plain sum of log ratios over all n-grams of a text, whatever its length.

Scale. Documents are read twice, in narrow passes; a pass of counts sends at most BUCKETS rows from each task. The label sample has at most
`labelled` rows, chosen by a hash of doc_id. The k-th largest key is found exactly by refining a histogram over a thin table, and so is the
place among ties; no sort of all rows, and at most 10,000 numbers reach the driver at once. Texts go to the workers in batches of 4 MB.

Defined results. Null and empty texts have no n-grams: log weight 0. Ties of keys at the cut go to the smaller doc_id, then to any
one of equal rows. Rows with equal doc_ids share their noise. An empty table gives no rows; without labelled good documents the target
model is uniform over what was seen, every weight is near 1 and everything is kept. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietframe.llm.common import LOWER, SPACE, Scratch, batches_of, column_bytes, mix64, row_uid, slices, text_or_empty, word_hashes

BUCKETS = 1 << 16
_KIND = np.full(256, 2, np.uint8)
_KIND[SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the unigrams and bigrams of every row, and the row of each."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[buf]
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[offsets[(offsets > 0) & (offsets < n)]] = True
    at = np.flatnonzero(edge)
    ends = np.append(at[1:], n)
    word = kind[at] > 0
    at, ends = at[word], ends[word]
    h = word_hashes(buf, at, ends, LOWER)
    row = np.searchsorted(offsets, at, "right") - 1
    same = row[1:] == row[:-1]
    two = mix64((h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1])[same])
    all_ = np.concatenate([h, two])
    return (all_ >> np.uint64(48)).astype(np.int64), np.concatenate([row, row[1:][same]])


def label_sample(labels: DataFrame, most: int) -> DataFrame:
    """doc_id, to_count, to_cut of at most `most` labelled documents, those of the least hash; the bound makes it fit to be broadcast.
    One half's labels serve the target model, the other half's the cut: a document that the model has counted looks better than it is."""
    one = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    half = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 0
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.when(half, F.col("label")).alias("to_count"), F.when(~half, F.col("label")).alias("to_cut"))


def count(docs: DataFrame) -> DataFrame:
    """bucket, raw, target: n-gram counts over all of docs (text, quality)."""
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, row = grams(*column_bytes(part.column(0)))
                raw += np.bincount(bucket, minlength=BUCKETS)
                good = part.column(1).fill_null(0).to_numpy() == 1
                if good.any():
                    target += np.bincount(bucket[good[row]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], schema=schema)

    parts = docs.select("text", F.col("quality").cast("int")).mapInArrow(counted, "bucket int, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: list[tuple[int, int, int]], smooth: float = 20.0) -> np.ndarray:
    """log of target over raw probability of every bucket, from (bucket, raw, target)."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in counts:
        raw[b], target[b] = r, t
    if not target.sum():
        return np.zeros(BUCKETS)
    p = (target + smooth) / (target + smooth).sum()
    # The raw model is smoothed in the same proportion, so that a bucket that neither has seen is neutral.
    s = smooth * max(1.0, raw.sum() / target.sum())
    q = (raw + s) / (raw + s).sum()
    return np.log(p) - np.log(q)


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, uid, quality, n_grams, log_weight of every row of docs (doc_id, text, quality, uid)."""
    schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("quality", pa.int32()), ("n_grams", pa.int64()), ("log_weight", pa.float64())])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, row = grams(*column_bytes(part.column(1)))
                n = np.bincount(row, minlength=part.num_rows)
                w = np.bincount(row, weights=ratios[bucket], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), part.column(2), pa.array(n), pa.array(w)], schema=schema)

    return docs.select("doc_id", "text", F.col("quality").cast("int"), "uid").mapInArrow(weighed, "doc_id long, uid long, quality int, n_grams long, log_weight double")


def fit_cut(weights: DataFrame, care: float = 20.0) -> float:
    """The cut on log weight that loses least on the labelled rows; a histogram of 4001 steps comes to the driver."""
    step = 0.25
    at = F.greatest(F.lit(-2000), F.least(F.lit(2000), F.floor(F.col("log_weight") / step))).cast("int")
    rows = weights.filter("quality IS NOT NULL").groupBy(at.alias("at"), F.col("quality")).count().collect()
    good, bad = np.zeros(4002), np.zeros(4002)
    for r in rows:
        (good if r["quality"] == 1 else bad)[r["at"] + 2000] += r["count"]
    if not bad.sum() or not good.sum():
        return -np.inf
    loss = care * np.concatenate([[0], np.cumsum(good)]) + np.concatenate([[0], np.cumsum(bad)])[-1] - np.concatenate([[0], np.cumsum(bad)])
    best = np.flatnonzero(loss == loss.min())
    return float((best[len(best) // 2] - 2000) * step)


def kth_largest(rows: DataFrame, column: str, k: int, gather: int = 10_000):
    """The k-th largest value of a column (numbers, no nulls; 1 <= k <= rows), and how many are larger. Histograms of 4096 steps narrow it down
    until at most `gather` values or equal ones are left."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    larger = 0
    while low != high:
        inside = rows.filter(F.col(column).between(low, high))
        part = (F.col(column).cast("double") / 2 - float(low) / 2) / max(float(high) / 2 - float(low) / 2, 5e-324) * 4096
        at = F.greatest(F.lit(0), F.least(F.lit(4095), F.floor(part))).cast("int")
        found = sorted(inside.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect(), reverse=True)
        if len(found) == 1 and found[0]["n"] > gather:  # too near each other for a histogram of doubles: halve by value
            middle = (low + high) / 2 if isinstance(low, float) else (low + high) // 2
            if isinstance(low, float) and not low < middle < high:
                middle = low
            n = inside.filter(F.col(column) > middle).count()
            low, high, larger = (inside.filter(F.col(column) > middle).agg(F.min(column)).first()[0], high, larger) if larger + n >= k else (low, inside.filter(F.col(column) <= middle).agg(F.max(column)).first()[0], larger + n)
            continue
        for _, n, low, high in found:
            if larger + n >= k:
                break
            larger += n
        if n <= gather:
            values = sorted((r[0] for r in inside.filter(F.col(column).between(low, high)).select(column).collect()), reverse=True)
            value = values[k - larger - 1]
            return value, larger + sum(v > value for v in values)
    return low, larger


def top_k(keys: DataFrame, k: int, gather: int = 10_000) -> DataFrame:
    """Marks the k rows of the largest key (doc_id, key, row: unique) as selected; ties of the key by doc_id (null first) and row."""
    if k >= keys.count():
        return keys.withColumn("selected", F.lit(True))
    if k <= 0:
        return keys.withColumn("selected", F.lit(False))
    edge, larger = kth_largest(keys, "key", k, gather)
    # Of the ties, the first by doc_id and row: their k-th largest when negated.
    own = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    ties = keys.filter(F.col("key") == edge).select((-1 - own).alias("doc"), (-F.col("row")).alias("at"))
    doc, before = kth_largest(ties, "doc", k - larger, gather)
    at, _ = kth_largest(ties.filter(F.col("doc") == doc), "at", k - larger - before, gather)
    upto = ((-1 - own) > doc) | (((-1 - own) == doc) & (-F.col("row") >= at))
    return keys.withColumn("selected", (F.col("key") > edge) | ((F.col("key") == edge) & upto))


def gumbel(seed: int):
    """Standard Gumbel noise from a hash of doc_id: 52 bits make a number between 0 and 1."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, spark: SparkSession, k: int | None = None, labelled: int = 20_000, care: float = 20.0, seed: int = 7) -> DataFrame:
    """doc_id, uid, row, n_grams, log_weight, key, selected of every row of docs; uid: a number for its doc_id and text; row tells all rows apart."""
    scratch = Scratch(spark, "quality")
    sample = scratch.table(label_sample(labels, labelled), "sample")
    own = docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text"), row_uid().alias("uid")).join(F.broadcast(sample), "doc_id", "left")
    with batches_of(spark):
        ratios = log_ratios([tuple(r) for r in count(own.withColumn("quality", F.col("to_count"))).collect()])
        weights = scratch.table(weigh(own.withColumn("quality", F.col("to_cut")), ratios).withColumn("row", F.monotonically_increasing_id()), "weights")
    if k is None:
        cut = fit_cut(weights, care)
        k = weights.filter(F.col("log_weight") >= F.lit(cut)).count()
    return top_k(weights.withColumn("key", F.col("log_weight") + gumbel(seed)).drop("quality"), k)
