"""op10's lines of one to four words, against the brute force of test_operators with their whole sequence as one token; and lines that 40 bits don't tell apart."""

import random
import re

import numpy as np

from quietframe.llm import line_dedup
from quietframe.llm.common import shingle_hashes, word_hashes, word_spans
from quietframe.llm.queries import op10_line_dedup

SCHEMA = "doc_id long, text string"


def _rows():
    rng = random.Random(6)
    some = ["Share this", "share, THIS!", "a b", "a b c", "b a", "a", "A.", "", "--", "one two three four", "one two three four five", "one two three four five six", "One two three four"]
    return [(i, "\n".join(rng.choice(some) for _ in range(rng.randrange(1, 5)))) for i in range(40)] + [(40, None), (41, "only here now"), (42, " ".join("abcdefgh")), (43, " ".join("abcdefghi"))]


def _want(rows):
    seen, out = [], {}
    for i, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            w = re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", line.lower())
            s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
            if s and any(len(s & x) / len(s | x) >= 0.8 for x in seen):
                continue
            kept.append(line)
            seen += [s] if s else []
        out[i] = None if t is None else "\n".join(kept)
    return out


def test_short_lines(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, spark, short=True).collect()} == _want(rows)


def test_query_takes_short_lines(spark, tmp_path):
    spark.createDataFrame([(0, "Share this\nx"), (1, "share this\ny")], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r["doc_id"], r["lines_removed"]) for r in op10_line_dedup(spark, str(tmp_path)).collect()) == [(0, 0), (1, 1)]


def test_lines_whose_first_40_bits_agree(spark):
    rng = np.random.default_rng(2)
    vocabulary = np.array([f"w{i}" for i in range(2000)])
    text = " ".join(vocabulary[pick := rng.integers(0, 2000, 6_000_000)]).encode()
    buf = np.frombuffer(text, np.uint8)
    hashes = shingle_hashes(word_hashes(buf, *word_spans(buf, np.zeros(0, np.int64))), 5)
    by = np.argsort(hashes)
    same = np.flatnonzero((hashes[by][1:] >> np.uint64(24) == hashes[by][:-1] >> np.uint64(24)) & (hashes[by][1:] != hashes[by][:-1]))
    assert len(same)
    lines = [" ".join(vocabulary[pick[i : i + 5]]) for k in same.tolist() for i in (by[k], by[k + 1])]
    out = line_dedup.dedup_lines(spark.createDataFrame([(0, "\n".join(lines)), (1, lines[0])], SCHEMA), spark)
    assert sorted((r["doc_id"], r["lines_removed"]) for r in out.collect()) == [(0, 0), (1, 1)]
