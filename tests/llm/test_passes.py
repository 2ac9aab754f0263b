"""What goes out whole goes out in passes that follow the corpus's size, with the same result."""

import random

import pytest
from pyspark.sql import functions as F

from quietframe.llm import line_dedup, set_dedup, set_join


def _texts():
    """Families of like lines around the threshold, and a larger one."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    out = []
    for size in [4] * 40 + [12]:
        first = [word() for _ in range(70)]
        for _ in range(size):
            w = list(first)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


def _set(text):
    w = text.split(" ")
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


@pytest.mark.parametrize("limits", [{}, {"block": 16, "tokens": 1000, "most": 8}])
@pytest.mark.parametrize("module", [line_dedup, set_dedup])
def test_sets_go_out_in_passes(spark, monkeypatch, module, limits):
    """Most texts are candidates: their sets don't go out all at once, and every match is found in some pass."""
    texts = _texts()
    sets = [_set(x) for x in texts]
    alike = [[i for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for j in range(len(sets))]
    went = []

    def counted(some, *carried, deal=set_join.by_blocks):
        out = deal(some, *carried)
        if "hashes" in carried:
            went.append(out.agg(F.sum(F.length("hashes"))).first()[0] or 0)
        return out

    monkeypatch.setattr(module, "by_blocks", counted)
    monkeypatch.setattr(set_join, "AT_ONCE", 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    if module is line_dedup:
        got = {r["doc_id"] for r in line_dedup.dedup_lines(docs, spark, **limits).collect() if r["lines_removed"]}
        assert got == {j for j, some in enumerate(alike) if some}
    else:
        label = list(range(len(sets)))
        for j, some in enumerate(alike):
            for i in some:
                label = [label[i] if x == label[j] else x for x in label]
        least = {x: label.index(x) for x in set(label)}
        got = {r["doc_id"]: r["component_id"] for r in set_dedup.near_duplicates(docs, spark, **limits).collect()}
        assert got == {j: least[x] for j, x in enumerate(label)}
    if not limits:
        matched = {frozenset(x) for j, some in enumerate(alike) for i in some if sets[i] != sets[j] for x in (sets[i], sets[j])}
        assert sum(went) >= 8 * sum(map(len, matched))
        assert len(went) > 1 and max(went) < 0.7 * sum(went)


def test_passes_hold_every_group_once(spark):
    """Every group of every component is in one pass, whole."""
    rows = spark.createDataFrame([(k * 7919, k % 9, 1 + k % 9) for k in range(400)], "key long, label long, blocks int")
    want = sorted(map(tuple, set_join.by_blocks(rows).collect()))
    got = [sorted(map(tuple, set_join.by_blocks(some).filter(own).collect())) for some, own in set_join.in_passes(rows, F.lit(10), 2500)]
    assert len(got) == 8 and sorted(x for part in got for x in part) == want
    groups = [{x[0] for x in part} for part in got]
    assert sum(map(len, groups)) == len(set.union(*groups))
