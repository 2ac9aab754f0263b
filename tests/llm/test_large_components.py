"""Chance meetings of large sets, and what the written tables leave on disk."""

import random
import time

import pytest

from quietframe.llm import line_dedup, set_dedup, set_join
from quietframe.llm.common import Scratch


def _word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(8))


def _texts():
    """Long lines that share passages of five words here and there, and some that differ from an earlier one in one word."""
    rng = random.Random(7)
    pool = [" ".join(_word(rng) for _ in range(5)) for _ in range(60)]
    lines = [" ".join(rng.choice(pool) if rng.random() < 0.5 else _word(rng) for _ in range(60)) for _ in range(240)]
    for i in range(12):
        w = lines[i].split(" ")
        w[rng.randrange(len(w))] = _word(rng)
        lines.append(" ".join(w))
    return lines


def _set(text):
    w = text.split(" ")
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


@pytest.mark.parametrize(("module", "most"), [(line_dedup, 20), (set_dedup, 2)])
def test_chance_meetings_are_not_dealt(spark, monkeypatch, module, most):
    """In a large corpus the counters hardly tell tokens apart, and most long lines meet some other: one component of them all, which isn't compared
    in blocks (the square of its size) but drawn again."""
    lines = _texts()
    sets = [_set(x) for x in lines]
    alike = {(i, j) for j in range(len(lines)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    rows = []

    def counted(some, *carried):
        out = set_join.by_blocks(some, *carried)
        rows.append(out.count())
        return out

    monkeypatch.setattr(module, "by_blocks", counted)
    monkeypatch.setattr(module, "rarity_classes", lambda counts: (counts * 0).astype("uint8"))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    if module is line_dedup:
        got = {r["doc_id"] for r in line_dedup.dedup_lines(docs, spark, most=most).collect() if r["lines_removed"]}
    else:
        got = {r["doc_id"] for r in set_dedup.near_duplicates(docs, spark, most=most).collect() if r["component_id"] < r["doc_id"]}
    assert got == {j for _, j in alike} and len(alike) == 12
    assert sum(rows) <= 3 * 2 * len(alike)  # a set once for each of the 3 tasks at most


def test_wide_bitmaps_fold(spark):
    """A bitmap of twice the slots says as much of a set as one folded; sets that match are never ruled out, whatever their sizes."""
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (10, 63, 64, 65, 120, 128, 129, 500, 513, 5000)]
    sets += [np.concatenate([x[: len(x) * 9 // 10], x[:0]]) for x in sets] + [np.concatenate([x, rng.integers(0, 1 << 63, len(x) // 5).astype(np.uint64)]) for x in sets]
    wide = np.array([set_join.wide_parity(x) for x in sets], object)
    marks = set_join.Marks(np.array([len(x) for x in sets]), np.full(len(sets), -1), wide)
    found = 0
    for i, x in enumerate(sets):
        may = marks.may(i, np.arange(len(sets)))
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            if both >= 0.8 * (len(x) + len(y) - both):
                found += i != j
                assert may[j]
            elif not both and min(len(x), len(y)) >= 60:
                assert not may[j]
    assert found > 20


def test_written_tables_leave_no_shuffle_files(spark):
    """Shuffle files of a written table go with the write, not at some garbage collection."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x and x.endswith(".data")}
    before = shuffles()
    out = Scratch(spark, "t").table(spark.range(1000).repartition(4, "id").groupBy("id").count(), "t")
    for _ in range(20):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before
    assert out.count() == 1000
