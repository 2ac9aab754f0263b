"""Exact percentiles without all values in one buffer. Spark's exact aggregate keeps every distinct value of a group, and all of them end in one
task. Here a sketch proposes bounds around each rank, a pass counts the values beyond them, and what lies beyond the tightest bounds that hold
the rank is drawn to these bounds. That moves no value between them, so the exact aggregate gives the same and keeps few: by AWAY 0.0004 of them, and the sketch's error.
Bounds are taken on counts alone: were the sketch wrong, they would be wider and the result the same."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

ACCURACY = 10_000
#: How far from a rank bounds are proposed, as shares of the rows; beyond these the least and the greatest value hold.
AWAY = (2 / ACCURACY, 0.01)
#: Groups whose bounds go to every task. Spark itself sends the rows of few groups to as few tasks.
FEW = 20_000
#: Rows of a group whose values may be in one buffer.
SMALL = 100_000


@dataclass(frozen=True)
class Rank:
    """A share of the rows, as a number or a constant in SQL, in the order of a column; discrete: a value that occurs, else interpolated."""

    column: str
    share: str
    discrete: bool = False

    def exact(self, column: str) -> Column:
        return F.expr(f"percentile_disc({self.share}) WITHIN GROUP (ORDER BY {column})" if self.discrete else f"percentile({column}, {self.share})")


def few_groups(df: DataFrame, by: Iterable[str]) -> bool | None:
    """Whether the bounds of all groups fit into each task; None if all groups are small. Runs a job over the keys, if there are any."""
    by = list(by)
    if not by:
        return True
    groups, largest = df.groupBy(*by).count().agg(F.count(F.lit(1)), F.max("count")).first()
    return None if (largest or 0) <= SMALL else groups <= FEW


def percentiles(df: DataFrame, ranks: dict[str, Rank], by: Iterable[str] = (), few: bool = True) -> DataFrame:
    """The keys and a column for each rank, by name: a row for each group, or one row without keys. NULLs don't count; NaN is the greatest value.
    few: bounds of all groups fit into each task; that changes no result."""
    by, columns = list(by), list(dict.fromkeys(r.column for r in ranks.values()))
    keys, at = [f"k{i}" for i in range(len(by))], {c: f"x{j}" for j, c in enumerate(columns)}
    types = {c: df.select(c).schema[0].dataType for c in columns}
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], *[(F.col(c).cast("double") if isinstance(types[c], NumericType | StringType) else F.col(c)).alias(x) for c, x in at.items()])

    def beside(few: DataFrame) -> DataFrame:
        """Each row with that of its group in few."""
        if not keys:
            return rows.crossJoin(F.broadcast(few))
        right, on = few.withColumnsRenamed({k: f"r_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
        return rows.join(F.broadcast(right) if few else right, on).drop(*[f"r_{k}" for k in keys])

    shares = {x: list(dict.fromkeys(f"{end}(CAST({r.share} AS double) {sign} {a}D, {to})" for r in ranks.values() if at[r.column] == x for a in AWAY for sign, end, to in (("-", "greatest", "0D"), ("+", "least", "1D")))) for x in at.values()}
    sketch = rows.groupBy(*keys).agg(*[F.expr(f"percentile_approx({x}, array({', '.join(s)}), {ACCURACY})").alias(x) for x, s in shares.items()], *[f(x).alias(f"{x}_{f.__name__}") for x in shares for f in (F.min, F.max)])
    sketch = sketch.select(*keys, *[F.col(f"{x}_{f}") for x in shares for f in ("min", "max")], *[F.get(x, F.lit(i)).alias(f"{x}_c{i}") for x, s in shares.items() for i in range(len(s))])
    proposed = {x: [f"{x}_c{i}" for i in range(len(s))] for x, s in shares.items()}
    counts = [F.count(x).alias(f"{x}_n") for x in proposed] + [f.alias(f"{c}_{n}") for x, cs in proposed.items() for c in cs for f, n in ((F.count_if(F.col(x) < F.col(c)), "below"), (F.count_if(F.col(x) <= F.col(c)), "upto"))]
    counted = beside(sketch).groupBy(*keys).agg(*counts, *[F.max(c).alias(c) for c in sketch.columns[len(keys):]])

    def bounds(r: Rank) -> tuple[Column, Column]:
        """With a row to spare on both sides, so that rounding of the rank doesn't matter."""
        x = at[r.column]
        rank = (F.col(f"{x}_n") - 1) * F.expr(f"CAST({r.share} AS double)")
        first, last = F.greatest(F.floor(rank) - 1, F.lit(0)), F.least(F.ceil(rank) + 2, F.col(f"{x}_n"))
        return (F.greatest(F.col(f"{x}_min"), *[F.when(F.col(f"{c}_below") <= first, F.col(c)) for c in proposed[x]]), F.least(F.col(f"{x}_max"), *[F.when(F.col(f"{c}_upto") >= last, F.col(c)) for c in proposed[x]]))

    held = counted.select(*keys, *[b.alias(f"{end}{i}") for i, r in enumerate(ranks.values()) for b, end in zip(bounds(r), ("low", "high"), strict=True)])
    drawn = beside(held).select(*keys, *[F.when(F.col(x := at[r.column]) < F.col(f"low{i}"), F.col(f"low{i}")).when(F.col(x) > F.col(f"high{i}"), F.col(f"high{i}")).otherwise(F.col(x)).alias(f"y{i}") for i, r in enumerate(ranks.values())])
    out = drawn.groupBy(*keys).agg(*[r.exact(f"y{i}").alias(name) for i, (name, r) in enumerate(ranks.items())])
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], *ranks)
