"""Private bounds of a column, and private set union."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietframe.operators.mechanisms import Odometer, OdometerHeterogeneous, Privacy, discrete_laplace
from quietframe.sources.shared import written

BINS = 64


def power_histogram(df: DataFrame, column: str) -> DataFrame:
    """bin and n: values by power of two, with edges 0, 1, 2, 4 and so on. Bin 1 is [0, 1), 2 is [1, 2), 3 is [2, 4); bin -1 is [-1, 0), -2 is
    [-2, -1), -3 is [-4, -2). The last bin of either side takes what is beyond it. At most 128 rows."""
    x = F.col(column).cast("double")
    size = F.greatest(F.abs(x), F.lit(1.0))
    near = F.floor(F.log2(size)).cast("double")
    two = F.lit(2.0)
    # log2 rounds: the power that is really the last one not over the size.
    power = F.when(F.pow(two, near) > size, near - 1).when(F.pow(two, near + 1) <= size, near + 1).otherwise(near)
    above = F.when(x < 1, 1).otherwise(power + 2)
    below = F.when(x >= -1, 1).otherwise(power + F.when(F.pow(two, power) == size, 1).otherwise(2))
    last = F.lit(float(BINS))
    number = F.when(x < 0, -F.least(last, below)).otherwise(F.least(last, above)).cast("int")
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.filter(fine).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _edges(b: int) -> tuple[float, float]:
    """The ends of a bin."""
    low, high = (0.0 if abs(b) == 1 else 2.0 ** (abs(b) - 2)), 2.0 ** (abs(b) - 1)
    return (low, high) if b > 0 else (-high, -low if low else 0.0)


def approx_bounds(df: DataFrame, column: str, epsilon: float, odometer: Odometer | OdometerHeterogeneous | None = None, noise: bool = True) -> tuple[float | None, float | None]:
    """Bounds that hold the column's values but for bins that noise hides; (None, None) if no bin stands out. Noise is drawn once."""
    source = random.SystemRandom()
    seen = {r["bin"]: r["n"] for r in power_histogram(df, column).collect()}
    noisy = {b: seen.get(b, 0) + (discrete_laplace(1 / epsilon, source) if noise else 0) for b in [*range(-BINS, 0), *range(1, BINS + 1)]}
    if odometer is not None:
        odometer.spend((epsilon, 0.0)) if isinstance(odometer, OdometerHeterogeneous) else odometer.spend()
    fail = 1e-10
    while fail < 0.1:
        # No empty bin passes this but for probability `fail`.
        cut = -math.log(1 - (1 - fail) ** (1 / (2 * BINS - 1))) / epsilon
        over = [b for b, n in noisy.items() if n > cut]
        if over:
            return _edges(min(over))[0], _edges(max(over))[1]
        fail *= 10
    return None, None


def set_union(df: DataFrame, key: str, item: str, privacy: Privacy, max_contrib: int = 5, odometer: OdometerHeterogeneous | None = None, order=None) -> DataFrame:
    """Items that may be shown: every individual spreads a weight of 1 over at most max_contrib items, weights are summed, get Laplace noise of
    scale 1 / epsilon, and pass a threshold that an item of one individual passes with probability delta at most (the weighted
    histogram of arXiv 2002.09745 with even weights). Distributed throughout; charged once."""
    pairs = df.filter(F.col(item).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key_"), F.col(item).alias("item_"), *([order.alias("order_")] if order is not None else [])).dropDuplicates(["key_", "item_"])
    w = Window.partitionBy("key_").orderBy(F.rand() if order is None else F.col("order_"))
    pairs = pairs.withColumn("rank_", F.row_number().over(w)).filter(F.col("rank_") <= max_contrib)
    each = Window.partitionBy("key_")
    total = pairs.withColumn("w", 1.0 / F.count(F.lit(1)).over(each)).groupBy("item_").agg(F.sum("w").alias("weight"))
    eps, delta = privacy.epsilon, privacy.delta
    rho = max(1 / t + (1 / eps) * math.log(1 / (2 * (1 - (1 - delta) ** (1 / t)))) for t in range(1, max_contrib + 1))

    def noisy(frames):
        source = random.SystemRandom()
        for f in frames:
            grid = 1 / 1024 / 1024
            f["weight"] = [round(x / grid) * grid + discrete_laplace(1 / eps / grid, source) * grid for x in f["weight"]]
            yield f

    out = written(total.mapInPandas(noisy, total.schema).filter(F.col("weight") > rho).select(F.col("item_").alias(item)), "union")
    if odometer is not None:
        odometer.spend(privacy)
    return out
