"""The engine's own operators: parsing, checks, mechanisms, accounting, releases, bounds, transforms, synthesizers, metrics and streaming."""

import math
import random
import statistics

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quietframe import queries as Q
from quietframe.evaluate import metrics as M
from quietframe.evaluate.runs import Analyze, Evaluate
from quietframe.operators.bounds import approx_bounds, set_union
from quietframe.operators.mechanisms import Gaussian, Laplace, Odometer, OdometerHeterogeneous, Privacy, compose, delta_of, rho_of
from quietframe.plans.ast import Binary, Column, Literal
from quietframe.plans.metadata import Metadata
from quietframe.plans.parser import ParseError, parse, parse_batch, parse_expression
from quietframe.plans.private import Analyzer, PrivateSession, QueryError, read, sensitivity_of, without_noise
from quietframe.streaming.budgeted import release_each_batch
from quietframe.synth import marginals as S
from quietframe.synth.models import DPLinearRegression, Synthesizer, exponential_mechanism, pmse_ratio, private_covariance, sra, wasserstein
from quietframe.transform.columns import Anonymization, Bin, Chain, Clamp, DateTime, Drop, Label, Log, MinMax, NoTransformer, OneHot, Standard, TableTransformer, infer_column_types, infer_pii, is_ids

META = {"": {"PEOPLE": {"PEOPLE": {"max_ids": 1, "pid": {"type": "int", "private_id": True}, "age": {"type": "int", "lower": 0, "upper": 100}, "income": {"type": "float", "lower": 0, "upper": 1000}, "sex": {"type": "string"}, "free": {"type": "float"}, "married": {"type": "boolean"}}}}}


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(-5, 120), rng.random() * 1500 if i % 7 else None, rng.choice("ab"), 1.0, bool(i % 2)) for i in range(2000)]
    return spark.createDataFrame([*rows, *rows[:500], (5000, 3, 1.0, "rare", 1.0, True), (None, 4, 2.0, "a", 1.0, None)], "pid long, age long, income double, sex string, free double, married boolean")


@pytest.mark.parametrize("text", ["SELECT a", "SELECT TOP 3 a FROM t", "SELECT DISTINCT a, b AS c FROM s.t WHERE a IS NOT NULL AND NOT b IN (1, -2)", "SELECT COUNT(*) FROM d.s.t x JOIN u USING (k) LEFT OUTER JOIN v ON x.a = v.b", 'SELECT "a b", [c d], `e` FROM t ORDER BY a DESC, b LIMIT 3', "SELECT CASE a WHEN 1 THEN 'x' ELSE 'it''s' END, CAST(a AS VARCHAR(3)), EXTRACT(DAY FROM d), SUBSTRING(a FROM 2 FOR 3), POSITION('x' IN a) FROM (SELECT * FROM t) AS q", "SELECT naïve, 1.5e3, CURRENT_DATE FROM t -- end", "SELECT ROW_NUMBER() OVER (PARTITION BY a ORDER BY b DESC) AS r FROM t", "SELECT a FROM t, u WHERE a BETWEEN 1 AND 2 AND b <=> 3"])
def test_parses(text):
    assert parse(text) == parse(text)


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT a FROM", "SELECT a FROM t WHERE", "SELECT a b c FROM t", "SELECT TOP 2 a FROM t LIMIT 3", "SELECT a FROM (SELECT b FROM t LIMIT 2) q", "SELECT a FROM t JOIN u", "SELECT CASE END FROM t", "SELECT a FROM a.b.c.d", "SELECT CAST(a AS BLOB) FROM t", "SELECT EXTRACT(ERA FROM a) FROM t", "SELECT 'open FROM t", "SELECT a FROM t; SELECT b FROM t", "SELECT a IS 3 FROM t"])
def test_refuses(text):
    with pytest.raises(ParseError):
        parse(text)


def test_precedence_and_batch():
    assert parse_expression("5 - 3 + 2") == Binary("+", Binary("-", Literal(5), Literal(3)), Literal(2))
    assert parse_expression("a OR b AND NOT c = -1") == parse_expression("a OR (b AND (NOT (c = -1)))")
    assert len(parse_batch("SELECT a; SELECT b;")) == 2


@pytest.mark.parametrize("text", ["SELECT sex, COUNT(*) FROM PEOPLE GROUP BY sex", "SELECT sex AS s, AVG(age) AS a, STDDEV(age) AS b FROM PEOPLE.PEOPLE GROUP BY s HAVING COUNT(*) > 3 ORDER BY a", "SELECT SUM(age) * 2 + COUNT(*) AS x, 3 AS three FROM PEOPLE p WHERE p.age > 3", "SELECT COUNT(DISTINCT pid) AS n, SUM(married) AS m FROM PEOPLE", "SELECT CASE WHEN COUNT(*) > 3 THEN 1 ELSE 0 END AS c FROM PEOPLE"])
def test_accepts(text):
    Analyzer(Metadata.from_dict(META), Privacy()).plan(text)


@pytest.mark.parametrize("text", ["SELECT * FROM PEOPLE", "SELECT age FROM PEOPLE", "SELECT age, COUNT(*) FROM PEOPLE", "SELECT SUM(age + 1) FROM PEOPLE", "SELECT SUM(sex) FROM PEOPLE", "SELECT SUM(free) FROM PEOPLE", "SELECT COUNT(*) FROM PEOPLE GROUP BY pid", "SELECT MIN(age) FROM PEOPLE", "SELECT COUNT(*) FROM PEOPLE JOIN PEOPLE USING (pid)", "SELECT COUNT(*) FROM (SELECT * FROM PEOPLE) q", "SELECT COUNT(*) AS a, COUNT(age) AS a FROM PEOPLE", "SELECT SUM(COUNT(*)) FROM PEOPLE", "SELECT COUNT(*) FROM nowhere", "SELECT COUNT(nothing) FROM PEOPLE", "SELECT SUM(pid) FROM PEOPLE", "SELECT DISTINCT COUNT(*) FROM PEOPLE"])
def test_rejects(text):
    with pytest.raises(ValueError):
        Analyzer(Metadata.from_dict(META), Privacy()).plan(text)


def test_sensitivities():
    s = {"a": 10.0, "b": 3.0}
    f = lambda text: sensitivity_of(parse_expression(text), lambda c: s.get(c.name))
    assert [f(t) for t in ("SUM(a)", "SUM(a) + SUM(b)", "SUM(a) * 2", "SUM(a) / 4", "COUNT(a)", "CASE WHEN 1 = 1 THEN SUM(b) ELSE SUM(a) END", "VAR(b)", "SUM(c)")] == [10, 13, 20, 2.5, 1, 10, 9, None]
    assert Column(("x",)).name == "x"


def test_metadata_round_trip(tmp_path):
    m = Metadata.from_dict(META)
    m.to_file(str(tmp_path / "m.yaml"))
    assert Metadata.from_file(str(tmp_path / "m.yaml")).to_dict() == m.to_dict()
    assert m.find(("people",)).max_ids == 1
    with pytest.raises(ValueError):
        m.find(("x",))


@pytest.mark.parametrize("epsilon", [0.1, 2.0])
@pytest.mark.parametrize("reach", [1, 33])
def test_accuracy(epsilon, reach):
    for mech in (Laplace(epsilon, 1e-5, float(reach)), Gaussian(epsilon, 1e-5, float(reach))):
        for whole in (True, False):
            x = mech.release([1000.0] * 2500, whole)
            for alpha in (0.01, 0.05):
                inside = statistics.mean(abs(v - 1000) <= mech.accuracy(alpha) for v in x)
                assert 1 - alpha - 0.04 < inside < 1 - alpha + 0.04
            assert abs(statistics.mean(x) - 1000) < 6 * mech.scale * 1.5 / 50


def test_closed_forms():
    assert Gaussian(1.0, 1e-5).scale == pytest.approx(4.0453, abs=1e-3)
    assert Laplace(1.0, 1e-5, 1, 1).threshold == pytest.approx(11.82, abs=0.01)
    assert Laplace(1.0, 1e-5, 1, 3).threshold == pytest.approx(38.76, abs=0.1)
    assert delta_of(rho_of(0.7, 1e-6), 0.7) == pytest.approx(1e-6, rel=0.01)
    with pytest.raises(ValueError):
        Laplace(1.0, 0, 1e8)
    with pytest.raises(ValueError):
        Privacy().mechanism("sum_float", None, 1)


@given(st.lists(st.floats(0.01, 2.0), min_size=1, max_size=30))
def test_composition_grows_and_is_at_most_the_sum(steps):
    spent = [compose([(e, 1e-7) for e in steps[:k]], 1e-6)[0] for k in range(1, len(steps) + 1)]
    assert all(a <= b + 1e-9 for a, b in zip(spent, spent[1:], strict=False))
    assert spent[-1] <= sum(steps) + 1e-9


def test_odometers():
    o = Odometer(Privacy(0.1, 1e-6))
    o.spend(200)
    assert o.spent[0] < 20 and o.k == 200
    h = OdometerHeterogeneous(Privacy(1.0, 1e-5), cap=2.5)
    h.spend(Privacy(1.0, 1e-5))
    h.spend((1.0, 0))
    with pytest.raises(ValueError):
        h.spend((1.0, 0))
    assert h.k == 2


def test_release_is_drawn_once_and_charged_once(spark, people):
    s = PrivateSession(spark, META, Privacy(1.0, 1e-5), {"PEOPLE.PEOPLE": people})
    text = "SELECT sex, COUNT(*) AS n, AVG(age) AS a FROM PEOPLE GROUP BY sex ORDER BY n DESC"
    cost = s.cost(text)
    out = s.execute(text)
    assert out.collect() == out.collect()
    assert s.odometer.k == 4 and s.odometer.spent == cost
    assert {r["sex"] for r in out.collect()} == {"a", "b"}  # "rare" is censored
    assert s.execute(text).collect() != out.collect()
    assert len(s.accuracy(text, 0.05)) == 3 and s.accuracy(text, 0.05)[0] is None
    capped = PrivateSession(spark, META, Privacy(1.0, 1e-5), {"PEOPLE": people}, cap=2)
    with pytest.raises(ValueError):
        capped.execute(text)
    assert capped.odometer.k == 0


def test_exact_path_without_noise(spark, people):
    s = PrivateSession(spark, META, Privacy(1.0, 1e-5), {"PEOPLE": people})
    got = s.execute("SELECT sex, COUNT(*) AS n, SUM(age) AS s, COUNT(income) AS c FROM PEOPLE WHERE age > 10 GROUP BY sex", order=F.col("age"), noise=without_noise).toPandas()
    p = people.toPandas()
    p = p[p.age > 10].drop_duplicates("pid")
    p["age"] = p.age.clip(0, 100)
    want = p.groupby("sex").agg(n=("age", "size"), s=("age", "sum"), c=("income", "count"))
    for r in got.itertuples():
        assert (r.n, r.s, r.c) == tuple(want.loc[r.sex])
    with pytest.raises(QueryError):
        s.execute("SELECT sex, COUNT(*) AS n FROM PEOPLE GROUP BY sex HAVING SUM(age) > 3", noise=without_noise)
    with pytest.raises(QueryError):
        s.execute("SELECT sex, COUNT(*) AS n FROM PEOPLE GROUP BY sex ORDER BY age", noise=without_noise)


def test_pre_aggregated(spark):
    s = PrivateSession(spark, META, Privacy(1.0, 1e-5))
    rows = pd.DataFrame({"keycount": [100, 2], "group_0": ["x", "y"], "count_all": [300, 2]})
    assert [r["sex"] for r in s.execute("SELECT sex, COUNT(*) AS n FROM PEOPLE GROUP BY sex", pre_aggregated=rows, noise=without_noise).collect()] == ["x"]
    with pytest.raises(QueryError):
        s.execute("SELECT sex, COUNT(*) AS n FROM PEOPLE GROUP BY sex", pre_aggregated=rows.drop(columns="keycount"))
    assert "keycount" in s.execute("SELECT sex, COUNT(*) AS n FROM PEOPLE GROUP BY sex", pre_aggregated=rows, postprocess=False).columns
    records = [("group_0", "keycount", "count_all"), ("x", 100, 300), ("y", 2, 2)]
    for some in (records, [list(r) for r in records], np.array(records, dtype=object)):
        assert [r["n"] for r in s.execute("SELECT sex, COUNT(*) AS n FROM PEOPLE GROUP BY sex", pre_aggregated=some, noise=without_noise).collect()] == [300]
    for bad in ([], records[:1], [("group_0", "keycount"), ("x", 1)]):
        with pytest.raises((QueryError, ValueError)):
            s.execute("SELECT sex, COUNT(*) AS n FROM PEOPLE GROUP BY sex", pre_aggregated=bad)


def test_heavy_keys_are_limited_before_the_shuffle(spark, people):
    s = PrivateSession(spark, META, Privacy(1.0, 1e-5), {"PEOPLE": people})
    plan = s.exact("SELECT sex, COUNT(*) AS n FROM PEOPLE WHERE age > 3 GROUP BY sex")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize(("values", "bounds"), [
    ([0, 1, 2, 3, 4, 5, 6, 7, 8, 9], (0, 16)),
    ([2.0**10, 2.0**20, 2.0**30, 2.0**40], (2.0**10, 2.0**41)),
    ([-(2.0**10), -(2.0**20), -(2.0**30), -(2.0**40)], (-(2.0**40), -(2.0**9))),
    ([2.0**10, -(2.0**20), -(2.0**30), 2.0**40, -0.5, -0.75], (-(2.0**30), 2.0**41)),
    ([0.0, 0.25, 0.4995], (0, 1)),
    ([-0.25, -0.4995, -1.0], (-1, 0)),
    ([2.0 ** (4 * p) for p in range(10)], (1, 2.0**37)),
    ([1, 3, 5, -6, -4.5, 25, -3, 299, 899], (-8, 1024)),
    ([-(2.0**65), 2.0**65, math.inf, -math.inf, math.nan, None], (-(2.0**63), 2.0**63)),
    ([math.inf, -math.inf, math.nan, None], (None, None)),
    ([1.5], (1, 2)),
    ([-2.0], (-2, -1)),
    ([2.0**29, 2.0**29 - 1], (2.0**28, 2.0**30)),
])
def test_approx_bounds_edges(spark, values, bounds):
    df = spark.createDataFrame([(None if x is None else float(x),) for x in values] * 100, "x double")
    assert approx_bounds(df, "x", 1.0, noise=False) == bounds


def test_bounds_and_set_union(spark):
    df = spark.createDataFrame([(float(x),) for x in [*range(1, 1000), 1e30] + [float("nan"), float("inf")]], "x double")
    assert approx_bounds(df, "x", 1.0, noise=False)[1] == 1024
    assert approx_bounds(spark.createDataFrame([(-5.0,)] * 500, "x double"), "x", 1.0)[0] <= -5
    assert approx_bounds(df.limit(0), "x", 1.0, noise=False) == (None, None)
    rows = [(i, "common") for i in range(500)] + [(1, "own")]
    o = OdometerHeterogeneous(Privacy(1.0, 1e-6))
    out = set_union(spark.createDataFrame(rows, "k long, v string"), "k", "v", Privacy(1.0, 1e-6), odometer=o)
    assert [r["v"] for r in out.collect()] == ["common"] and o.k == 1


def test_transforms_come_back(spark):
    df = spark.createDataFrame([(i, float(i), "abc"[i % 3] if i % 5 else None, f"2020-01-{i + 1:02d}") for i in range(20)], "i int, x double, s string, d string")
    for column, t in (("x", MinMax(lower=0, upper=19)), ("x", MinMax(lower=0, upper=19, nullable=True)), ("s", Label()), ("x", Chain([Clamp(upper=100), Log()])), ("s", Chain([Label(), OneHot()]))):
        t.fit(df, column)
        cols = t.transform(F.col(column))
        assert len(cols) == t.width
        for r in df.select(F.col(column).alias("a"), *[c.alias(f"c{i}") for i, c in enumerate(cols)]).select("a", t.inverse([F.col(f"c{i}") for i in range(len(cols))]).alias("b")).collect():
            assert r["a"] == r["b"] or r["a"] in (None, 0.0) or abs(r["a"] - r["b"]) < 1e-6
    b = Bin(bins=4, lower=0, upper=19).fit(df, "x")
    assert [r[0] for r in df.select(b.transform(F.col("x"))[0]).collect()][-1] == 3
    t = DateTime().fit(df, "d")
    assert df.select(t.inverse(t.transform(F.col("d"))).alias("v")).first()["v"].startswith("2020-01-01")
    day = 19358.5  # noon of 2023-01-01
    texts = {"2023-01-01": 19358.0, "2023-01-01 12:00:00": day, "2023-01-01 12:00:00.5": day + 0.5 / 86400, "2023-01-01 12:00:00 PM": day, "2023-01-01 12:00:00.500000 PM": day + 0.5 / 86400, "2023-01-01T12:00:00": day, "2023-01-01T12:00:00.250": day + 0.25 / 86400, "12:00:00": 0.5, "12:00:00.5": 0.5 + 0.5 / 86400, "01/01/2023": 19358.0, "01/01/2023 12:00:00": day, "01.01.2023": 19358.0, "2023/01/01": 19358.0, "20230101": 19358.0, "soon": None}
    for r in spark.createDataFrame(list(texts.items()), "d string, v double").select("d", "v", t.transform(F.col("d"))[0].alias("x")).collect():
        assert r["x"] == (None if r["v"] is None else pytest.approx(r["v"], abs=1e-9)), r
    zones = spark.createDataFrame([("2023-01-01T12:00:00+02:00",), ("2023-01-01T10:00:00Z",), ("2023-01-01T12:00:00.000+0200",)], "d string")
    assert len({r[0] for r in zones.select(t.transform(F.col("d"))[0]).collect()}) == 1
    same = NoTransformer().fit(df)
    assert same.inverse(same.transform(df)).collect() == df.collect() and same.transform(df).columns == df.columns
    assert Standard(lower=0, upper=19, epsilon=5.0).fit(df, "x").deviation > 0
    table = TableTransformer({"x": MinMax(lower=0, upper=19), "s": Label(), "d": Drop(), "i": Anonymization("email")}).fit(df)
    back = table.inverse(table.transform(df))
    assert back.columns == ["x", "s", "i"] and "@" in back.first()["i"]
    kinds = infer_column_types(df)
    assert kinds["ordinal"] == ["i", "x"] and kinds["categorical"] == ["s"] and kinds["pii"] == {"d": "datetime"}
    assert infer_pii(["a@b.c"]) == "email" and is_ids([3, 1, 2]) and not is_ids([1, 5])


@pytest.mark.parametrize("name,options", [("mwem", {"iterations": 6}), ("mwem", {"iterations": 8, "q_count": 20}), ("mst", {}), ("aim", {}), ("pacsynth", {}), ("quail", {"target": "b"})])
def test_synthesizers_keep_marginals(spark, name, options):
    rng = random.Random(2)
    rows = [(a := rng.choice([0, 0, 0, 1]), a if rng.random() < 0.9 else 1 - a, rng.choice("xyz")) for _ in range(4000)]
    df = spark.createDataFrame(rows, "a int, b int, c string")
    s = Synthesizer.create(name, epsilon=5.0, **options).fit(df, categorical_columns=["a", "b", "c"])
    out = s.sample(spark, 3000).toPandas()
    assert len(out) == 3000 and abs((out.a == 0).mean() - 0.75) < 0.12 and (out.a == out.b).mean() > 0.6
    if name == "mst":
        assert set(s.sample_conditional(spark, 50, "a = 1").toPandas().a) == {1}


def test_all_tables_in_one_pass(spark):
    rows = [(i % 3, i % 5, i % 2 if i % 7 else None) for i in range(200)] + [(9, 0, 0)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    wanted = [(0,), (2,), (0, 1), (1, 2), (0, 1, 2)]
    for some, x, (cell, n) in zip(wanted, S.tables(df, ["a", "b", "c"], [3, 5, 2], wanted), S.occurring(df, ["a", "b", "c"], [3, 5, 2], wanted), strict=True):
        brute = np.zeros([[3, 5, 2][i] for i in some])
        for r in rows:
            if all(r[i] is not None and r[i] < [3, 5, 2][i] for i in some):
                brute[tuple(r[i] for i in some)] += 1
        assert (x == brute).all() and (brute.ravel()[cell] == n).all() and n.sum() == brute.sum()
    assert S.tables(df, ["a", "b", "c"], [2, 5, 2], [(0, 2)], {0: [1, 0, 1]})[0].sum() == sum(r[2] is not None and r[0] < 3 for r in rows)
    assert S.tables(df.limit(0), ["a"], [3], [(0,)])[0].tolist() == [0, 0, 0]
    with pytest.raises(ValueError, match="large"):
        S.tables(df, ["a", "b"], [10_000, 10_000], [(0, 1)])


def test_seeded_rows_keep_triples(spark):
    """c is the exclusive or of a and b: no pair says anything of it."""
    rng = random.Random(4)
    df = spark.createDataFrame([(a := rng.randrange(2), b := rng.randrange(2), a ^ b) for _ in range(4000)], "a int, b int, c int")
    s = Synthesizer.create("pacsynth", epsilon=6.0).fit(df, categorical_columns=["a", "b", "c"])
    out = s.sample(spark, 2000).toPandas()
    assert ((out.a ^ out.b) == out.c).mean() > 0.9
    found = s.aggregates()
    assert set(found["attributes"]) == {"a", "b", "c", "a;b", "a;c", "b;c", "a;b;c"} and (found["attributes"] == "a;b;c").sum() == 4
    short = Synthesizer.create("pacsynth", epsilon=6.0, reporting_length=2).fit(df, categorical_columns=["a", "b", "c"]).sample(spark, 2000).toPandas()
    assert ((short.a ^ short.b) == short.c).mean() < 0.65


def test_trees_compress_and_adapt(spark):
    rng = random.Random(5)
    rows = [(v := rng.choice([0, 1, 2]) if rng.random() < 0.98 else rng.randrange(3, 60), v % 2, rng.randrange(3), rng.randrange(2)) for _ in range(5000)]
    df = spark.createDataFrame(rows, "v int, odd int, x int, y int")
    mst = Synthesizer.create("mst", epsilon=2.0).fit(df, ordinal_columns=["v", "odd", "x", "y"])
    assert mst.shape[0] > 40 and mst.size[0] < 20  # rare values became one
    out = mst.sample(spark, 3000).toPandas()
    assert (out.v > 2).mean() == pytest.approx(0.02, abs=0.03) and out.v.max() > 2
    aim = Synthesizer.create("aim", epsilon=2.0, workload=[["v", "odd"]]).fit(df, ordinal_columns=["v", "odd", "x", "y"])
    steps = [sigma for _, sigma in aim.measured]
    assert all(b <= a * (1 + 1e-9) for a, b in zip(steps, steps[1:], strict=False)) and steps[-1] < steps[0] and (0, 1) in [e for e, _ in aim.measured]
    out = aim.sample(spark, 3000).toPandas()
    assert (out.v % 2 == out.odd).mean() > 0.8
    with pytest.warns(UserWarning, match="measured"):
        Synthesizer.create("aim", epsilon=2.0, max_cells=10).fit(df, ordinal_columns=["v", "odd", "x", "y"])


def test_neural_names_say_what_they_need():
    for name in ("dpctgan", "patectgan", "dpgan", "pategan"):
        with pytest.raises(NotImplementedError, match="torch"):
            Synthesizer.create(name)


def test_regression_and_usefulness(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(x := rng.random(), y := rng.random(), 2 * x - y + 0.5) for _ in range(3000)], "x double, y double, z double")
    bounds = {"x": (0, 1), "y": (0, 1), "z": (-1, 3)}
    model = DPLinearRegression(True).fit(df, ["x", "y"], "z", bounds, 1.0, noise=False)
    assert model.coef_ == pytest.approx([2, -1], abs=1e-6) and model.intercept_ == pytest.approx(0.5, abs=1e-6)
    noisy = DPLinearRegression().fit(df, ["x", "y"], "z", bounds, 50.0)
    assert noisy.coef_ == pytest.approx([2, -1], abs=0.5)
    assert private_covariance(df, ["x"], bounds, 1.0, noise=False)[0, 0] == pytest.approx(1 / 12, abs=0.01)
    assert wasserstein(df, df, "x") == 0 and sra([1, 2, 3], [2, 3, 4]) == 1
    a = df.select((F.col("x") > 0.5).cast("int").alias("u"))
    assert pmse_ratio(a, a, ["u"]) < 0.1 < pmse_ratio(a, a.withColumn("u", F.lit(1)), ["u"])
    assert exponential_mechanism([0, 1000], 10.0) == 1


def test_runs_of_metrics(spark, people, tmp_path):
    d = M.Dataset(people, ["sex", "married"], ["age"])
    path = str(tmp_path / "out.json")
    found = Analyze(d, workload=[{"metric": "Entropy"}, {"metric": "DistinctCount"}], output_path=path).run()
    assert len(found) == 2 + 3
    assert len(Analyze(d, workload=[{"metric": "Entropy"}], output_path=path).run()) == 5  # taken up, not run again
    run = Evaluate(d, [M.Dataset(people.filter("sex <> 'b'"), ["sex", "married"], ["age"], idx=1)], workload=[{"metric": "SuppressedCombinationCount"}, {"metric": "MeanAbsoluteErrorInCount"}], run_len=1)
    values = {(r["name"], tuple(r["parameters"]["columns"])): r["value"] for r in run.run()}
    assert values["SuppressedCombinationCount", ("sex",)] == 1 and values["MeanAbsoluteErrorInCount", ("sex",)]["Bin 0"] == 0
    assert M.Metric.deserialize(M.Metric.create("Mean", column="age").serialize()).compute(d)["value"] is not None


def test_stream_releases_each_batch(spark, people, tmp_path):
    people.filter("pid IS NOT NULL").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(people.schema).parquet(str(tmp_path / "in"))
    s = PrivateSession(spark, META, Privacy(1.0, 1e-5))
    q = release_each_batch(stream, s, "PEOPLE", "SELECT sex, COUNT(*) AS n FROM PEOPLE GROUP BY sex", str(tmp_path / "out"), checkpointLocation=str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and s.odometer.k == 2
    # A new session takes the account up: the next batch would go over its cap, and nothing of it is released.
    people.filter("pid IS NOT NULL").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = PrivateSession(spark, META, Privacy(1.0, 1e-5), cap=s.odometer.spent[0] * 1.1)
    q = release_each_batch(stream, again, "PEOPLE", "SELECT sex, COUNT(*) AS n FROM PEOPLE GROUP BY sex", str(tmp_path / "out"), checkpointLocation=str(tmp_path / "ck"))
    with pytest.raises(Exception, match="budget"):
        q.processAllAvailable()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and again.odometer.steps == s.odometer.steps


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_queries_match_sql(spark, name):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in Q.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    out = Q.QUERIES[name](spark, d)
    got = sorted(([_value(r[x]) for x in sorted(out.columns)] for r in out.collect()), key=str)
    cur = c.execute(Q.ORACLE[name])
    names = [x[0] for x in cur.description]
    want = sorted(([_value(r[names.index(x)]) for x in sorted(names)] for r in cur.fetchall()), key=str)
    assert sorted(out.columns) == sorted(names) and got == want


def test_public_read_escapes(spark):
    df = spark.createDataFrame([("{x}", 1)], "s string, n int")
    assert read(spark, "SELECT n FROM t WHERE s = '{x}'", {"t": df}).collect()[0]["n"] == 1
