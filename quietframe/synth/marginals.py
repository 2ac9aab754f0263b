"""Counts of combinations of columns, the exact stage of every synthesizer. Data is aggregated by Spark; only tables of a checked size
reach the driver."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CELLS = 50_000_000
MOST_OCCURRING = 5_000_000


def marginal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def marginals(df: DataFrame, columns: Sequence[str], width: int) -> DataFrame:
    """Counts of all combinations of `width` columns in one pass: each row is expanded to (columns, values) and aggregated."""
    parts = [F.struct(F.lit(",".join(some)).alias("columns"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in some]).alias("values")) for some in combinations(columns, width)]
    return df.select(F.explode(F.array(*parts)).alias("p")).groupBy("p.columns", "p.values").agg(F.count(F.lit(1)).alias("n"))


def _cells(df: DataFrame, columns: Sequence[str], shape: Sequence[int], wanted: Sequence[Sequence[int]], maps: dict[int, list[int]] | None = None) -> DataFrame:
    """part (a place in wanted), cell (row-major within the part), n: the counts of all wanted combinations of integer columns in one pass.
    Rows with a value that is null or out of range don't count where that column takes part. maps: new codes of a column by old ones."""
    code = [F.get(F.from_json(F.lit(json.dumps(maps[i])), "array<int>"), F.col(f"`{c}`").cast("int")) if maps and i in maps else F.col(f"`{c}`").cast("bigint") for i, c in enumerate(columns)]
    inside = df.select(*[F.when(x.between(0, n - 1), x.cast("bigint")).alias(f"c{i}") for i, (x, n) in enumerate(zip(code, shape, strict=True))])
    parts = []
    for k, some in enumerate(wanted):
        cell = F.lit(0).cast("bigint")
        for i in some:
            cell = cell * int(shape[i]) + F.col(f"c{i}")
        parts.append(F.struct(F.lit(k).alias("part"), cell.alias("cell")))
    return inside.select(F.explode(F.array(*parts)).alias("p")).filter("p.cell IS NOT NULL").groupBy("p.part", "p.cell").agg(F.count(F.lit(1)).alias("n"))


def tables(df: DataFrame, columns: Sequence[str], shape: Sequence[int], wanted: Sequence[Sequence[int]], maps: dict[int, list[int]] | None = None) -> list[np.ndarray]:
    """The dense tables of counts of all wanted combinations (places in columns), in one pass over the data."""
    sizes = [math.prod(int(shape[i]) for i in some) for some in wanted]
    if sum(sizes) > MOST_CELLS:
        raise ValueError(f"tables of {sum(sizes)} cells are too large; split the columns")
    if not wanted:
        return []
    found = _cells(df, columns, shape, wanted, maps).toPandas()  # at most one row for each cell
    out = np.zeros(sum(sizes))
    out[np.cumsum([0, *sizes])[found["part"].to_numpy(np.int64)] + found["cell"].to_numpy(np.int64)] = found["n"]
    return [x.reshape([int(shape[i]) for i in some]) for x, some in zip(np.split(out, np.cumsum(sizes)[:-1]), wanted, strict=True)]


def table(df: DataFrame, columns: Sequence[str], shape: Sequence[int]) -> np.ndarray:
    """The dense table of counts of integer columns."""
    return tables(df, columns, shape, [range(len(columns))])[0]


def occurring(df: DataFrame, columns: Sequence[str], shape: Sequence[int], wanted: Sequence[Sequence[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each wanted combination its cells that occur, ascending, and their counts; for tables too large to be dense."""
    if any(math.prod(int(shape[i]) for i in some) >= 1 << 63 for some in wanted):
        raise ValueError("a combination has too many cells to number")
    if not wanted:
        return []
    found = _cells(df, columns, shape, wanted).limit(MOST_OCCURRING + 1).toPandas()
    if len(found) > MOST_OCCURRING:
        raise ValueError(f"more than {MOST_OCCURRING} combinations occur; shorten or split them")
    found = found.sort_values(["part", "cell"])
    return [(own["cell"].to_numpy(np.int64), own["n"].to_numpy(float)) for own in (found[found["part"] == k] for k in range(len(wanted)))]


def covariance_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n, sums and sums of products of columns, the lower triangle, in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(F.col(c).cast("double")).alias(f"s_{c}") for c in columns]
    aggs += [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"p_{a}_{b}") for i, a in enumerate(columns) for b in columns[: i + 1]]
    return df.agg(*aggs)
