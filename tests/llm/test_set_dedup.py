"""The pipeline's near-dedup stage against brute force, on planted copies at similarities around the threshold."""

import collections
import random
import re

import pytest
from corpus_pipeline import near_stage

from quietframe.llm import set_dedup

SCHEMA = "doc_id long, text string"


def _words(rng, n):
    return ["".join(rng.choice(["ti", "re", "es", "la", "de", "ou", "Sch", "ñ", "É"]) for _ in range(4)) for _ in range(n)]


def _set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _alike(a, b):
    return a == b or bool(a and b) and len(a & b) / len(a | b) >= 0.8


def _rows():
    rng = random.Random(4)
    texts = []
    for _ in range(40):  # a text and copies whose last words differ: similarity 0.7 to 0.97
        w = _words(rng, rng.randrange(30, 400))
        texts.append(" ".join(w))
        for share in (0.97, 0.95, 0.9, 0.85, 0.81, 0.8, 0.78, 0.7):
            keep = round((len(w) - 4) * 2 * share / (1 + share)) + 4
            texts.append(" ".join(w[:keep] + _words(rng, len(w) - keep)))
    w = _words(rng, 200)  # a dense family: one word changed anywhere
    for _ in range(60):
        v = list(w)
        v[rng.randrange(len(v))] = "changed"
        texts.append("\n".join([" ".join(v[:100]), " ".join(v[100:])]))
    passage = _words(rng, 60)  # texts that share a passage alone
    texts += [" ".join(_words(rng, rng.randrange(40, 300)) + passage) for _ in range(40)]
    texts += [None, "", "  ", "a b", "A  b", "a b c", "b", "b", "one two three four five", "One two three four five"]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "alone")]


@pytest.mark.parametrize(("block", "tokens"), [(20_000, 1 << 21), (16, 3000)])
def test_documents_at_the_threshold(spark, block, tokens):
    rows = _rows()
    sets = [_set(t) for _, t in rows]
    label = list(range(len(rows)))
    find = lambda i: i if label[i] == i else find(label[i])
    near = 0
    for i in range(len(rows)):
        for j in range(i):
            if _alike(sets[i], sets[j]):
                near += sets[i] != sets[j]
                label[find(i)] = find(j)
    assert near > 1000
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [d] if d is not None else []
    want = collections.Counter((d, min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows))
    got = collections.Counter(tuple(r) for r in set_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), spark, block, tokens).select("doc_id", "component_id").collect())
    assert got == want


def test_stage_takes_near_copies(spark):
    rng = random.Random(8)
    w = _words(rng, 300)
    rows = [(0, " ".join(w)), (1, " ".join(w[:274] + _words(rng, 26))), (2, " ".join(w[:290] + _words(rng, 10))), (3, " ".join(_words(rng, 300)))]
    assert [r["doc_id"] for r in near_stage(spark, spark.createDataFrame(rows, SCHEMA), "").orderBy("doc_id").collect()] == [0, 3]
    assert near_stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
