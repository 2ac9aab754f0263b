"""Metrics where they meet ties or more values than one task should hold."""

import datetime
import math

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from quietframe import queries as Q
from quietframe.evaluate import metrics as M
from quietframe.operators import quantiles
from quietframe.plans.parser import parse
from quietframe.plans.private import _escaped, read, render_select


@pytest.fixture
def shuffled(spark):
    """Bytes from shuffles of the stage that read most of them since the test began."""
    sc = spark.sparkContext._jsc.sc()
    began = sc.dagScheduler().nextStageId()

    def largest():
        sc.listenerBus().waitUntilEmpty()
        found = []
        for stage in range(began, sc.dagScheduler().nextStageId()):
            try:
                found.append(sc.statusStore().lastStageAttempt(stage).shuffleReadBytes())
            except Py4JJavaError:  # a stage that was skipped
                continue
        assert found
        return max(found)

    return largest


def test_most_linkable_takes_the_column_of_its_sql_at_a_tie(spark, tmp_path):
    """Every status and every date has ten rows or more, as at sf0.1: both columns have the value 0."""
    rows = [(i, "FOP"[i % 3], datetime.datetime(1995, 1, 1 + i % 4)) for i in range(120)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    assert [tuple(r) for r in Q.QUERIES["metric_most_linkable"](spark, str(tmp_path)).collect()] == [("o_orderdate", 0)]
    # A column with more such rows wins, wherever it stands.
    d = M.Dataset(spark.createDataFrame([("a" if i else "b", i % 2) for i in range(40)], "x string, y int"))
    assert M.most_linkable(d, ["x", "y"]).collect()[0].asDict() == {"column": "x", "value": 1}


def test_percentiles_are_exact_and_few_values_meet_in_one_task(spark, shuffled):
    """Before, each distinct value came to the last task once for each of the percentiles, 7.3 MB here."""
    df = spark.range(200_000).select(F.when(F.col("id") % 10 > 0, F.rand(7)).alias("x")).union(spark.createDataFrame([(None,), (float("inf"),), (-1e300,)], "x double"))
    got = M.percentiles(M.Dataset(df), "x", (0, 0.25, 0.5, 0.999)).collect()[0].asDict()
    assert (largest := shuffled()) < 1_000_000, largest
    values = sorted(r["x"] for r in df.dropna().collect())

    def at(q):
        rank = q * (len(values) - 1)
        low, high = values[math.floor(rank)], values[math.ceil(rank)]
        return low if low == high else low + (high - low) * (rank - math.floor(rank))

    assert got == {"p_0": -1e300, "p_25": pytest.approx(at(0.25), abs=1e-15), "p_50": pytest.approx(at(0.5), abs=1e-15), "p_100": pytest.approx(at(0.999), abs=1e-15)}


@pytest.mark.parametrize("rows", [[], [None, None], [1.5], [0.0] * 9 + [1.0], [float("nan"), None, 2.0, float("-inf")], [float(i % 3) for i in range(50)]])
def test_percentiles_of_odd_columns(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "x double")
    want = df.agg(*[F.percentile("x", F.lit(q)).alias(f"p_{round(100 * q)}") for q in (0.25, 0.5, 0.75)]).collect()
    assert str(M.percentiles(M.Dataset(df), "x").collect()) == str(want)


SQL = [
    "SELECT PERCENTILE_CONT(x, 0.5) FROM t",
    "SELECT PERCENTILE_CONT(x, 0.5) AS a, COUNT(*) AS n FROM t WHERE FALSE",
    "SELECT g, PERCENTILE_DISC(x, 0.25) AS a, PERCENTILE_CONT(y, 0.9) AS b, COUNT(*) AS n, SUM(y) AS s FROM t GROUP BY g ORDER BY g",
    "SELECT g AS h, PERCENTILE_CONT(x, 0.5) + 1 AS a FROM t GROUP BY h ORDER BY PERCENTILE_CONT(x, 0.5) DESC",
    "SELECT y % 3 AS g, PERCENTILE_CONT(t.x * 2, 0.75) AS a FROM t WHERE x > 0.1 OR y > 5 GROUP BY 1 HAVING PERCENTILE_CONT(t.x, 0.5) > 0.4 ORDER BY g",
    "SELECT MAX(a) AS m FROM (SELECT g, PERCENTILE_CONT(x, 0.5) AS a FROM t GROUP BY g) AS q",
    "SELECT u.name, PERCENTILE_CONT(x, 0.5) AS a, MIN(y) AS lo FROM t JOIN u USING (g) GROUP BY u.name ORDER BY u.name",
    "SELECT PERCENTILE_CONT(x, 0.5) AS a FROM t WHERE x > (SELECT PERCENTILE_CONT(x, 0.5) FROM t WHERE g <> '{x}') AND g <> '{x}'",
    "SELECT g, (SELECT PERCENTILE_CONT(v.y, 0.5) FROM t AS v WHERE v.g = u.g) AS a FROM u ORDER BY g",
]


@pytest.mark.parametrize("few", [20_000, 0])
@pytest.mark.parametrize("text", SQL)
def test_percentiles_in_sql_as_the_aggregate_alone(spark, text, few, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 0)
    monkeypatch.setattr(quantiles, "FEW", few)
    t = spark.range(3000).select(F.when(F.col("id") % 11 > 0, F.rand(5)).alias("x"), (F.col("id") % 17).cast("int").alias("y"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("g"), F.col("id") % 4)).alias("g"))
    tables = {"t": t, "u": spark.createDataFrame([("g1", "one"), ("g2", "two"), ("g3", "two")], "g string, name string")}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)  # scalar subqueries read these
    want = spark.sql(render_select(_escaped(parse(text)), table=lambda x: "{" + x.parts[-1] + "}" + ("" if x.alias else f" AS {x.parts[-1]}")), **tables)
    got = read(spark, text, tables)
    assert got.dtypes == want.dtypes and [[v if not isinstance(v, float) else round(v, 12) for v in r] for r in got.collect()] == [[v if not isinstance(v, float) else round(v, 12) for v in r] for r in want.collect()]


def test_few_values_of_a_group_meet_in_one_task(spark, shuffled, tmp_path):
    """Before, each distinct value of a group came to one task: 6.1 MB here in all, now mostly sketches."""
    spark.range(0, 600_000, 1, 2).select(F.rand(7).alias("x"), (F.col("id") % 3).alias("g")).write.parquet(str(tmp_path / "t"))
    got = read(spark, "SELECT g, PERCENTILE_CONT(x, 0.5) AS p, COUNT(*) AS n FROM t GROUP BY g", {"t": spark.read.parquet(str(tmp_path / "t"))})
    assert sorted(r["n"] for r in got.collect()) == [200_000] * 3
    assert (largest := shuffled()) < 2_000_000, largest


def test_small_groups_stay_with_the_aggregate_alone(spark):
    t = spark.range(1000).select((F.col("id") % 100).alias("g"), F.col("id").alias("x"))
    assert quantiles.few_groups(t, ["g"]) is None and quantiles.few_groups(t, []) and quantiles.few_groups(t.limit(0), ["g"]) is None
    assert len(read(spark, "SELECT g, PERCENTILE_CONT(x, 0.5) AS p FROM t GROUP BY g", {"t": t}).collect()) == 100
