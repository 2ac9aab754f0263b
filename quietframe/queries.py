"""Queries of the engine's own operators over the supplied tables, with DuckDB SQL for those that are deterministic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietframe.evaluate import metrics as M
from quietframe.operators.bounds import power_histogram, set_union
from quietframe.operators.mechanisms import Gaussian, Laplace, Privacy
from quietframe.plans.private import PrivateSession, read, without_noise
from quietframe.sources.readers import Sources
from quietframe.synth import marginals as S
from quietframe.synth.models import Synthesizer
from quietframe.transform import columns as C

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "documents")
#: Privacy metadata of the supplied tables.
METADATA = {
    "": {
        "public": {
            "orders": {"max_ids": 1, "o_orderkey": {"type": "int"}, "o_custkey": {"type": "int", "private_id": True}, "o_orderstatus": {"type": "string"}, "o_totalprice": {"type": "float", "lower": 1000, "upper": 300000}, "o_orderdate": {"type": "datetime"}, "o_orderpriority": {"type": "string"}},
            "orders3": {"max_ids": 3, "o_orderkey": {"type": "int"}, "o_custkey": {"type": "int", "private_id": True}, "o_orderstatus": {"type": "string"}, "o_totalprice": {"type": "float", "lower": 1000, "upper": 300000}, "o_orderdate": {"type": "datetime"}, "o_orderpriority": {"type": "string"}},
            "lineitem": {"row_privacy": True, "l_orderkey": {"type": "int"}, "l_linenumber": {"type": "int", "lower": 0, "upper": 7}, "l_quantity": {"type": "float", "lower": 5, "upper": 45}, "l_extendedprice": {"type": "float", "lower": 0, "upper": 100000}, "l_discount": {"type": "float", "lower": 0, "upper": 0.1}, "l_returnflag": {"type": "string"}, "l_linestatus": {"type": "string"}, "l_shipdate": {"type": "datetime"}},
            "events": {"max_ids": 2, "event_id": {"type": "int"}, "user_id": {"type": "int", "private_id": True}, "event_type": {"type": "string"}, "value": {"type": "float", "lower": 1, "upper": 200, "missing_value": 10}, "ts": {"type": "datetime"}},
        }
    }
}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str) -> Sources:
    src = Sources(spark)
    for t in TABLES:
        src.add(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    src.add("orders3", src.tables["orders"])
    return src


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def public(name: str, text: str, sql: str | None = None) -> None:
    """A query of the engine's dialect over public tables."""
    register(name, sql or text)(lambda spark, d: read(spark, text, tables(spark, d)))


def zero_noise(name: str, text: str, sql: str, order: str | None = None) -> None:
    """A private query with all of its path but the noise, and without a sampling that SQL couldn't repeat (order: a column to sample by)."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        s = PrivateSession(spark, METADATA, Privacy(1.0, 1e-5), tables(spark, d))
        return s.execute(text, order=F.col(order) if order else None, noise=without_noise)

    register(name, sql)(run)


# ---- exact stages of private SQL

CLAMP = "CASE WHEN o_totalprice < 1000 THEN 1000 WHEN o_totalprice > 300000 THEN 300000 ELSE o_totalprice END"
ONE = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders {w})"
TAU1 = Laplace(1.0, 1e-5, 1, 1).threshold
TAU3 = Laplace(1.0, 1e-5, 1, 3).threshold

zero_noise("clamp_sum_orders", "SELECT o_orderstatus AS status, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus", f"SELECT o_orderstatus AS status, count(*) AS n, round(sum({CLAMP}), 2) AS total FROM {ONE.format(w='')} WHERE rn <= 1 GROUP BY 1 HAVING count(*) > {TAU1}", "o_orderkey")
zero_noise("contribution_bound_orders", "SELECT o_orderpriority AS p, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS k FROM orders3 GROUP BY o_orderpriority", f"SELECT o_orderpriority AS p, count(*) AS n, count(DISTINCT o_custkey) AS k FROM {ONE.format(w='')} WHERE rn <= 3 GROUP BY 1 HAVING count(DISTINCT o_custkey) > {TAU3}", "o_orderkey")
zero_noise("filter_before_sampling", "SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY o_orderstatus", f"SELECT o_orderstatus AS status, count(*) AS n FROM {ONE.format(w='WHERE o_totalprice > 150000')} WHERE rn <= 1 GROUP BY 1 HAVING count(*) > {TAU1}", "o_orderkey")
zero_noise("keycount_by_status", "SELECT o_orderstatus AS status, COUNT(DISTINCT o_custkey) AS k FROM orders3 GROUP BY o_orderstatus", f"SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS k FROM {ONE.format(w='')} WHERE rn <= 3 GROUP BY 1 HAVING k > {TAU3}", "o_orderkey")
zero_noise("row_privacy_count_lineitem", "SELECT l_returnflag AS f, l_linestatus AS s, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", f"SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > {TAU1}")
_Q = "greatest(least(l_quantity, 45), 5)"
zero_noise("avg_decomposed", "SELECT l_returnflag AS f, ROUND(AVG(l_quantity), 4) AS a, ROUND(SUM(l_quantity), 2) AS s FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag AS f, round(avg({_Q}), 4) AS a, round(sum({_Q}), 2) AS s FROM lineitem GROUP BY 1")
zero_noise("variance_decomposed", "SELECT l_returnflag AS f, ROUND(VAR(l_quantity), 3) AS v FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag AS f, round(var_pop({_Q}), 3) AS v FROM lineitem GROUP BY 1")
zero_noise("stddev_decomposed", "SELECT l_linestatus AS f, ROUND(STDDEV(l_quantity), 3) AS v FROM lineitem GROUP BY l_linestatus", f"SELECT l_linestatus AS f, round(stddev_pop({_Q}), 3) AS v FROM lineitem GROUP BY 1")
zero_noise("impute_then_clamp_events", "SELECT event_type AS t, ROUND(SUM(value), 2) AS s, COUNT(value) AS n FROM events GROUP BY event_type", f"SELECT event_type AS t, round(sum(least(greatest(coalesce(value, 10), 1), 200)), 2) AS s, count(coalesce(value, 10)) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 2 GROUP BY 1 HAVING count(DISTINCT user_id) > {Laplace(1.0, 1e-5, 1, 2).threshold}", "event_id")
zero_noise("group_by_expression", "SELECT l_linenumber % 3 AS m, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber % 3", "SELECT l_linenumber % 3 AS m, count(*) AS n FROM lineitem GROUP BY 1")
zero_noise("having_on_output", "SELECT l_linenumber AS k, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber HAVING COUNT(*) > 5000", "SELECT l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 5000")
zero_noise("order_by_expression", "SELECT l_linenumber AS k, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber ORDER BY COUNT(*) DESC, k LIMIT 3", "SELECT l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, k LIMIT 3")
zero_noise("top_n", "SELECT TOP 2 l_returnflag AS f, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag ORDER BY n DESC", "SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC LIMIT 2")
zero_noise("threshold_censor_zero_noise", "SELECT FLOOR(o_totalprice / 5000) AS d, COUNT(*) AS n FROM orders GROUP BY FLOOR(o_totalprice / 5000)", f"SELECT CAST(floor(o_totalprice / 5000) AS BIGINT) AS d, count(*) AS n FROM {ONE.format(w='')} WHERE rn <= 1 GROUP BY 1 HAVING count(*) > 1 - ln(2 * 1e-5)", "o_orderkey")
zero_noise("aggregate_expressions", "SELECT l_returnflag AS f, COUNT(*) * 2 + 1 AS a, ROUND(LN(COUNT(*)), 6) AS b, 3 AS three FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag AS f, count(*) * 2 + 1 AS a, round(ln(count(*)), 6) AS b, 3 AS three FROM lineitem GROUP BY 1")

# ---- expressions over public tables

public("case_searched", "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS c FROM part")
public("case_simple", "SELECT r_regionkey AS k, CASE r_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS c FROM region")
public("iif_choose", "SELECT n_nationkey AS k, IIF(n_regionkey > 2, 'hi', 'lo') AS a, CHOOSE(n_regionkey, 'x', 'y') AS b FROM nation", "SELECT n_nationkey AS k, CASE WHEN n_regionkey > 2 THEN 'hi' ELSE 'lo' END AS a, CASE n_regionkey WHEN 1 THEN 'x' WHEN 2 THEN 'y' END AS b FROM nation")
public("in_list_between", "SELECT n_nationkey AS k, n_regionkey IN (1, 3) AS a, n_nationkey BETWEEN 3 AND 7 AS b, n_regionkey NOT IN (0) AS c FROM nation")
public("is_null_true_false", "SELECT doc_id AS k, quality IS NULL AS a, quality IS TRUE AS b, toxic IS NOT FALSE AS c FROM labels", "SELECT doc_id AS k, quality IS NULL AS a, coalesce(CAST(quality AS VARCHAR) IN ('true','t','y','yes','on','1'), false) AS b, NOT coalesce(CAST(toxic AS VARCHAR) IN ('false','f','n','no','off','0'), false) AS c FROM labels")
public("math_functions", "SELECT l_orderkey AS k, l_linenumber AS n, ROUND(SQRT(l_quantity), 6) AS a, SQUARE(l_linenumber) AS b, ROUND(EXP(l_discount), 6) AS c, SIGN(l_discount) AS d, ROUND(POWER(l_tax, 2), 6) AS e, ABS(l_linenumber - 4) AS f, ROUND(SIN(l_quantity), 6) AS g FROM lineitem", "SELECT l_orderkey AS k, l_linenumber AS n, round(sqrt(l_quantity), 6) AS a, pow(l_linenumber, 2) AS b, round(exp(l_discount), 6) AS c, CAST(sign(l_discount) AS DOUBLE) AS d, round(pow(l_tax, 2), 6) AS e, abs(l_linenumber - 4) AS f, round(sin(l_quantity), 6) AS g FROM lineitem")
public("log_functions", "SELECT l_orderkey AS k, l_linenumber AS n, ROUND(LN(l_quantity), 6) AS a, ROUND(LOG10(l_quantity), 6) AS b, ROUND(LOG2(l_quantity), 6) AS c, CEIL(l_discount) AS d, FLOOR(l_quantity) AS e FROM lineitem", "SELECT l_orderkey AS k, l_linenumber AS n, round(ln(l_quantity), 6) AS a, round(log10(l_quantity), 6) AS b, round(log2(l_quantity), 6) AS c, CAST(ceil(l_discount) AS BIGINT) AS d, CAST(floor(l_quantity) AS BIGINT) AS e FROM lineitem")
public("trig_functions", "SELECT l_orderkey AS k, l_linenumber AS n, ROUND(COS(l_quantity), 6) AS a, ROUND(TAN(l_tax), 6) AS b, ROUND(ASIN(l_discount), 6) AS c, ROUND(ACOS(l_discount), 6) AS d, ROUND(ATAN(l_quantity), 6) AS e, ROUND(ATANH(l_discount), 6) AS f, ROUND(DEGREES(l_tax), 6) AS g, ROUND(PI(), 6) AS h FROM lineitem", "SELECT l_orderkey AS k, l_linenumber AS n, round(cos(l_quantity), 6) AS a, round(tan(l_tax), 6) AS b, round(asin(l_discount), 6) AS c, round(acos(l_discount), 6) AS d, round(atan(l_quantity), 6) AS e, round(atanh(l_discount), 6) AS f, round(degrees(l_tax), 6) AS g, round(pi(), 6) AS h FROM lineitem")
public("limit_n", "SELECT n_nationkey AS k, n_name AS n FROM nation ORDER BY n_nationkey LIMIT 5")
public("substring_edges", "SELECT n_nationkey AS k, SUBSTRING(n_name FROM 1 FOR 100) AS a, SUBSTRING(n_name FROM 100 FOR 2) AS b FROM nation", "SELECT n_nationkey AS k, n_name AS a, '' AS b FROM nation")
public("precedence_and_minus", "SELECT n_nationkey AS k, 2 + n_nationkey * 3 - -n_regionkey AS a, -(n_nationkey - 4) * 2 AS b, (n_nationkey + 1) * (n_regionkey + 2) AS c FROM nation")
public("select_star", "SELECT * FROM region", "SELECT * FROM region")
public("comma_join", "SELECT n_name AS n, r_name AS r FROM nation, region WHERE n_regionkey = r_regionkey")
public("dayname_weekday", "SELECT o_orderkey AS k, DAYNAME(o_orderdate) AS d, EXTRACT(WEEKDAY FROM o_orderdate) AS w FROM orders", "SELECT o_orderkey AS k, dayname(o_orderdate) AS d, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS w FROM orders")
public("round_half_even", "SELECT n_nationkey AS k, ROUND(n_nationkey / 2) AS a FROM nation", "SELECT n_nationkey AS k, round_even(n_nationkey / 2.0::DOUBLE, 0) AS a FROM nation")
public("trunc_floor", "SELECT c_custkey AS k, TRUNC(c_acctbal) AS a, TRUNCATE(c_acctbal, -2) AS b FROM customer", "SELECT c_custkey AS k, floor(c_acctbal) AS a, floor(c_acctbal * 0.01) * 100.0 AS b FROM customer")
public("division_modulo", "SELECT n_nationkey AS k, (n_nationkey - 9) / n_regionkey AS a, (n_nationkey - 9) % 4 AS b FROM nation", "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 0 THEN 0.0 ELSE CAST(n_nationkey - 9 AS DOUBLE) / n_regionkey END AS a, ((n_nationkey - 9) % 4 + 4) % 4 AS b FROM nation")
public("string_functions", "SELECT n_nationkey AS k, UPPER(n_name) AS a, LOWER(n_name) AS b, TRIM(CONCAT('  ', n_name, ' ')) AS c, CHAR_LENGTH(n_name) AS d, POSITION('A' IN n_name) AS e, SUBSTRING(n_name FROM 2 FOR 3) AS f, SUBSTRING(n_name FROM -2) AS g, COALESCE(NULL, n_name) AS h FROM nation", "SELECT n_nationkey AS k, upper(n_name) AS a, lower(n_name) AS b, n_name AS c, length(n_name) AS d, position('A' IN n_name) AS e, substring(n_name, 2, 3) AS f, right(n_name, 2) AS g, n_name AS h FROM nation")
public("cast_matrix", "SELECT c_custkey AS k, CAST(c_acctbal AS INTEGER) AS a, CAST(c_custkey AS FLOAT) AS b, CAST(c_custkey AS VARCHAR(2)) AS c, CAST('x' AS INTEGER) AS d FROM customer", "SELECT c_custkey AS k, CAST(trunc(c_acctbal) AS BIGINT) AS a, CAST(c_custkey AS DOUBLE) AS b, substring(CAST(c_custkey AS VARCHAR), 1, 2) AS c, CAST(NULL AS BIGINT) AS d FROM customer")
public("extract_parts", "SELECT event_id AS k, EXTRACT(YEAR FROM ts) AS a, EXTRACT(MONTH FROM ts) AS b, EXTRACT(DAY FROM ts) AS c, EXTRACT(HOUR FROM ts) AS d, EXTRACT(MINUTE FROM ts) AS e, EXTRACT(SECOND FROM ts) AS f, EXTRACT(WEEKDAY FROM ts) AS g, DAYNAME(ts) AS h FROM events", "SELECT event_id AS k, year(ts) AS a, month(ts) AS b, day(ts) AS c, hour(ts) AS d, minute(ts) AS e, second(ts) AS f, isodow(ts) - 1 AS g, dayname(ts) AS h FROM events")

# ---- relations

_JOIN = "SELECT c.c_custkey AS k, n.n_name AS n FROM customer c {kind} JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey < 3"
for _kind in ("inner", "left", "right", "full"):
    public(f"join_{_kind}", _JOIN.format(kind=_kind.upper()))
public("join_semi", "SELECT n_nationkey AS k FROM nation LEFT SEMI JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 1", "SELECT n_nationkey AS k FROM nation SEMI JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 1")
public("join_anti", "SELECT n_nationkey AS k FROM nation LEFT ANTI JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 1", "SELECT n_nationkey AS k FROM nation ANTI JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 1")
public("join_cross", "SELECT a.r_regionkey AS x, b.n_nationkey AS y FROM region a CROSS JOIN nation b")
public("join_using", "SELECT o_orderkey AS k, COUNT(*) AS n FROM (SELECT l_orderkey AS o_orderkey FROM lineitem) l INNER JOIN orders USING (o_orderkey) GROUP BY o_orderkey")
public("ranking_functions", "SELECT o_orderkey AS k, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS b, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC) AS c FROM orders")
public("subquery_from", "SELECT s.o_orderstatus AS st, MAX(s.n) AS m FROM (SELECT o_orderstatus, o_custkey, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_custkey) AS s GROUP BY s.o_orderstatus")
public("distinct_rows", "SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem")
public("min_max_percentiles", "SELECT o_orderstatus AS st, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, ROUND(PERCENTILE_CONT(o_totalprice, 0.5), 4) AS p FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus AS st, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(quantile_cont(o_totalprice, 0.5), 4) AS p FROM orders GROUP BY 1")
public("quoted_names", 'SELECT n."n_name" AS [a b], `n_nationkey` AS k FROM "nation" AS n', 'SELECT n_name AS "a b", n_nationkey AS k FROM nation')

# ---- mechanisms


# Laplace: scale = max_ids sensitivity / epsilon, threshold = max_ids (1 - ln(2 delta / max_ids) / epsilon).
@register("noisy_scale_table", """
    SELECT 'laplace' AS mechanism, s AS sensitivity, k AS max_ids, e AS epsilon, round(k * s / e, 4) AS scale, round(k * (1 - ln(2 * 1e-5::DOUBLE / k) / e), 4) AS threshold
    FROM (VALUES (1.0::DOUBLE, 1, 1.0::DOUBLE), (100.0::DOUBLE, 3, 0.5::DOUBLE), (2.0::DOUBLE, 2, 0.1::DOUBLE)) t(s, k, e)""")
def noisy_scale_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, m.sensitivity, m.max_contrib, m.epsilon, round(m.scale, 4), round(m.threshold, 4)) for n, m in (("laplace", Laplace(1.0, 1e-5, 1.0, 1)), ("laplace", Laplace(0.5, 1e-5, 100.0, 3)), ("laplace", Laplace(0.1, 1e-5, 2.0, 2)))]
    return spark.createDataFrame(rows, "mechanism string, sensitivity double, max_ids int, epsilon double, scale double, threshold double")


@register("power2_histogram", """
    WITH edges AS (SELECT CAST(i AS INTEGER) AS bin, CASE WHEN i = 1 THEN 0 ELSE pow(2, i - 2) END AS lo, pow(2, i - 1) AS hi FROM range(1, 65) t(i))
    SELECT bin, count(*) AS n FROM (SELECT bin FROM customer JOIN edges ON c_acctbal >= lo AND c_acctbal < hi UNION ALL SELECT -bin FROM customer JOIN edges ON c_acctbal >= -hi AND c_acctbal < -lo) GROUP BY bin""")
def power2_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return power_histogram(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_acctbal")


def _session(spark: SparkSession, sf_dir: str, **mechanisms: str) -> PrivateSession:
    return PrivateSession(spark, METADATA, Privacy(1.0, 1e-5, mechanisms=mechanisms or None), tables(spark, sf_dir))


register("private_release_orders")(lambda s, d: _session(s, d).execute("SELECT o_orderstatus AS status, COUNT(*) AS n, SUM(o_totalprice) AS total, AVG(o_totalprice) AS mean FROM orders WHERE o_totalprice > 0 GROUP BY o_orderstatus ORDER BY status"))
register("private_gaussian")(lambda s, d: _session(s, d, count="gaussian", threshold="gaussian").execute("SELECT l_returnflag AS f, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag"))
register("private_variance")(lambda s, d: _session(s, d).execute("SELECT l_returnflag AS f, VAR(l_quantity) AS v, STDDEV(l_quantity) AS sd FROM lineitem GROUP BY l_returnflag"))
register("dpsu_events")(lambda s, d: set_union(s.read.parquet(f"{d}/events.parquet"), "user_id", "event_type", Privacy(2.0, 1e-4)))

# ---- metrics


def metric(name: str, f: Callable[[Callable[[str], M.Dataset]], DataFrame], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        def data(t: str, **roles) -> M.Dataset:
            return M.Dataset(spark.read.parquet(f"{d}/{t}.parquet"), **roles)

        out = f(data)
        return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    register(f"metric_{name}", sql)(run)


LI = ["l_returnflag", "l_linestatus", "l_linenumber"]
metric("cardinality", lambda t: M.cardinality(t("lineitem"), "l_returnflag"), "SELECT count(DISTINCT l_returnflag) AS value FROM lineitem")
metric("entropy", lambda t: M.entropy(t("lineitem"), "l_linenumber"), "SELECT round(-sum(p * log2(p)), 6) AS value FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY l_linenumber)")
metric("mean", lambda t: M.mean(t("lineitem"), "l_quantity"), "SELECT round(sum(l_quantity) / count(*), 6) AS value FROM lineitem")
metric("variance", lambda t: M.variance(t("lineitem"), "l_quantity"), "SELECT round(var_samp(l_quantity), 6) AS value FROM lineitem")
metric("standard_deviation", lambda t: M.standard_deviation(t("lineitem"), "l_quantity"), "SELECT round(stddev_samp(l_quantity), 6) AS value FROM lineitem")
metric("median", lambda t: M.median(t("lineitem"), "l_quantity"), "SELECT quantile_disc(l_quantity, 0.5) AS value FROM lineitem")
metric("percentiles", lambda t: M.percentiles(t("orders"), "o_totalprice"), "SELECT round(quantile_cont(o_totalprice, 0.25), 6) AS p_25, round(quantile_cont(o_totalprice, 0.5), 6) AS p_50, round(quantile_cont(o_totalprice, 0.75), 6) AS p_75 FROM orders")
metric("skewness", lambda t: M.skewness(t("orders"), "o_totalprice"), "SELECT round(avg(pow(o_totalprice - m, 3)) / pow(avg(pow(o_totalprice - m, 2)), 1.5), 6) AS value FROM orders, (SELECT avg(o_totalprice) AS m FROM orders)")
metric("kurtosis", lambda t: M.kurtosis(t("orders"), "o_totalprice"), "SELECT round(avg(pow(o_totalprice - m, 4)) / pow(avg(pow(o_totalprice - m, 2)), 2) - 3, 6) AS value FROM orders, (SELECT avg(o_totalprice) AS m FROM orders)")
metric("range", lambda t: M.value_range(t("orders"), "o_totalprice"), "SELECT round(min(o_totalprice), 6) AS low, round(max(o_totalprice), 6) AS high FROM orders")
metric("mutual_information", lambda t: M.mutual_information(t("lineitem"), "l_returnflag", "l_linestatus"), "WITH p AS (SELECT l_returnflag a, l_linestatus b, count(*) n FROM lineitem GROUP BY ALL), q AS (SELECT n, sum(n) OVER () t, sum(n) OVER (PARTITION BY a) x, sum(n) OVER (PARTITION BY b) y FROM p) SELECT round(sum(n / t * log2(n * t / (x * y))), 6) AS value FROM q")
_COMBOS = "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL"
_DIM = "count(DISTINCT l_returnflag) * count(DISTINCT l_linestatus) * count(DISTINCT l_linenumber)"
metric("dimensionality", lambda t: M.dimensionality(t("lineitem"), LI), f"SELECT {_DIM} AS value FROM lineitem")
metric("distinct_count", lambda t: M.distinct_count(t("lineitem"), LI), f"SELECT count(*) AS value FROM ({_COMBOS})")
metric("sparsity", lambda t: M.sparsity(t("lineitem"), LI), f"SELECT round(count(*)::DOUBLE / ({_DIM}), 6) AS value FROM ({_COMBOS})")
_DAY = ["o_orderdate", "o_orderpriority"]
_DAYS = "SELECT o_orderdate, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL"
metric("below_k_combinations", lambda t: M.below_k_combinations(t("orders"), _DAY), f"SELECT CAST(count_if(n < 10) AS BIGINT) AS value, round(100.0::DOUBLE * count_if(n < 10) / count(*), 6) AS percentage FROM ({_DAYS})")
metric("below_k_count", lambda t: M.below_k_count(t("orders"), _DAY), f"SELECT CAST(coalesce(sum(n) FILTER (n < 10), 0) AS BIGINT) AS value, round(100.0::DOUBLE * coalesce(sum(n) FILTER (n < 10), 0) / sum(n), 6) AS percentage FROM ({_DAYS})")
metric("row_count", lambda t: M.row_count(t("orders")), "SELECT count(*) AS value FROM orders")
metric("singled_out_count", lambda t: M.singled_out_count(t("orders"), _DAY), f"SELECT CAST(count_if(n = 1) AS BIGINT) AS value, round(100.0::DOUBLE * count_if(n = 1) / count(*), 6) AS percentage FROM ({_DAYS})")
metric("most_linkable", lambda t: M.most_linkable(t("orders"), ["o_orderstatus", "o_orderdate"]), "SELECT 'o_orderdate' AS \"column\", CAST(coalesce(sum(n) FILTER (n < 10), 0) AS BIGINT) AS value FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderdate)")
metric("redacted_row_count", lambda t: M.redacted_row_count(t("lineitem"), ["l_returnflag", "l_linestatus"], "O"), "SELECT CAST(count_if((l_returnflag = 'O') <> (l_linestatus = 'O')) AS BIGINT) AS partly, CAST(count_if(l_returnflag = 'O' AND l_linestatus = 'O') AS BIGINT) AS fully FROM lineitem")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    joined = spark.read.parquet(f"{d}/labels.parquet").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    return M.auc(M.Dataset(joined), "quality", "n_chars").select(F.round("value", 6).alias("value"))


register("metric_auc", "WITH x AS (SELECT quality q, n_chars s FROM labels JOIN documents USING (doc_id)), r AS (SELECT q, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0) AS r FROM x) SELECT round((sum(r) FILTER (q = 1) - count_if(q = 1) * (count_if(q = 1) + 1) / 2.0) / (count_if(q = 1) * count_if(q = 0)), 6)::DOUBLE AS value FROM r")(_scored)


def _pair(name: str, f: Callable[[M.Dataset, M.Dataset], DataFrame], sql: str) -> None:
    """The original is lineitem; the synthetic one is all its rows, with lines over 6 numbered 6 and the quantity one more where it is even."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        li = spark.read.parquet(f"{d}/lineitem.parquet")
        out = f(M.Dataset(li), M.Dataset(li.withColumns({"l_linenumber": F.expr("least(l_linenumber, 6)"), "l_quantity": F.expr("CASE WHEN l_quantity % 2 = 0 THEN l_quantity + 1 ELSE l_quantity END")})))
        return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    register(f"compare_{name}", sql)(run)


_C = ["l_returnflag", "l_linenumber"]
_AB = "WITH a AS (SELECT l_returnflag f, l_linenumber k, count(*) n, sum(l_quantity) / count(*) x FROM lineitem GROUP BY ALL), b AS (SELECT l_returnflag f, least(l_linenumber, 6) k, count(*) n, sum(CASE WHEN l_quantity % 2 = 0 THEN l_quantity + 1 ELSE l_quantity END) / count(*) x FROM lineitem GROUP BY ALL), j AS (SELECT CASE WHEN a.n >= 100000 THEN 5 WHEN a.n >= 10000 THEN 4 WHEN a.n >= 1000 THEN 3 WHEN a.n >= 100 THEN 2 WHEN a.n >= 10 THEN 1 ELSE 0 END AS bin, a.n AS n, a.x AS x, coalesce(b.n, 0) AS m, coalesce(b.x, 0) AS y FROM a LEFT JOIN b USING (f, k)) "
_pair("mean_absolute_error", lambda a, b: M.mean_absolute_error(a, b, _C, "l_quantity"), _AB + "SELECT bin, round(avg(abs(x - y)), 6) AS value FROM j GROUP BY 1")
_pair("mean_absolute_error_in_count", lambda a, b: M.mean_absolute_error_in_count(a, b, _C), _AB + "SELECT bin, round(avg(abs(n - m)), 6) AS value FROM j GROUP BY 1")
_pair("mean_error", lambda a, b: M.mean_error(a, b, _C), _AB + "SELECT round(avg(m - n), 6) AS value FROM j")
_pair("mean_proportional_error", lambda a, b: M.mean_proportional_error(a, b, _C, "l_quantity"), _AB + "SELECT bin, round(sum((y - x) / x) * 100 / count(*), 6) AS value FROM j GROUP BY 1")
_pair("mean_proportional_error_in_count", lambda a, b: M.mean_proportional_error_in_count(a, b, _C), _AB + "SELECT bin, round(sum((m - n) / n) * 100 / count(*), 6) AS value FROM j GROUP BY 1")
_pair("suppressed_combinations", lambda a, b: M.suppressed_combination_count(a, b, _C), "SELECT count(*) AS value FROM (SELECT l_returnflag, l_linenumber FROM lineitem EXCEPT SELECT l_returnflag, least(l_linenumber, 6) FROM lineitem)")
_pair("fabricated_combinations", lambda a, b: M.fabricated_combination_count(b, a, _C), "SELECT count(*) AS value FROM (SELECT l_returnflag, l_linenumber FROM lineitem EXCEPT SELECT l_returnflag, least(l_linenumber, 6) FROM lineitem)")

# ---- transforms


def transform(name: str, table: str, key: str, column: str, t: Callable[[], C.Transformer], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = spark.read.parquet(f"{d}/{table}.parquet")
        made = t().fit(df, column)
        cols = made.transform(F.col(column))
        out = df.select(F.col(key).alias("k"), *[c.alias(f"v{i}") for i, c in enumerate(cols)], *([made.inverse(cols).alias("back")] if cols else []))
        return out.select(*[F.round(c, 6).alias(c) if ty == "double" else F.col(c) for c, ty in out.dtypes])

    register(f"transform_{name}", sql)(run)


transform("label", "orders", "o_orderkey", "o_orderstatus", C.Label, "SELECT o_orderkey AS k, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS v0, o_orderstatus AS back FROM orders")
transform("onehot", "nation", "n_nationkey", "n_regionkey", C.OneHot, "SELECT n_nationkey AS k, " + ", ".join(f"CAST(n_regionkey = {i} AS INTEGER) AS v{i}" for i in range(5)) + ", CAST(n_regionkey AS INTEGER) AS back FROM nation")
transform("minmax", "customer", "c_custkey", "c_acctbal", lambda: C.MinMax(lower=0, upper=5000), "SELECT c_custkey AS k, round(least(greatest(c_acctbal, 0), 5000) / 5000 * 2 - 1, 6) AS v0, round(least(greatest(c_acctbal, 0), 5000), 6) AS back FROM customer")
transform("bin", "customer", "c_custkey", "c_acctbal", lambda: C.Bin(bins=10, lower=0, upper=5000), "SELECT c_custkey AS k, CAST(least(9, floor(10 * least(greatest(c_acctbal, 0), 5000) / 5000)) AS INTEGER) AS v0, round((least(9, floor(10 * least(greatest(c_acctbal, 0), 5000) / 5000)) + 0.5) * 500, 6) AS back FROM customer")
transform("clamp", "customer", "c_custkey", "c_acctbal", lambda: C.Clamp(upper=4000, lower=0), "SELECT c_custkey AS k, round(least(greatest(c_acctbal, 0), 4000), 6) AS v0, round(least(greatest(c_acctbal, 0), 4000), 6) AS back FROM customer")
transform("log", "orders", "o_orderkey", "o_totalprice", C.Log, "SELECT o_orderkey AS k, round(ln(o_totalprice), 6) AS v0, round(exp(ln(o_totalprice)), 6) AS back FROM orders")
transform("datetime_days", "orders", "o_orderkey", "o_orderdate", C.DateTime, "SELECT o_orderkey AS k, round(epoch_us(o_orderdate) / 86400000000.0::DOUBLE, 6) AS v0, o_orderdate AS back FROM orders")
transform("drop", "nation", "n_nationkey", "n_name", C.Drop, "SELECT n_nationkey AS k FROM nation")

# ---- marginals and synthesizers

register("one_way_marginals", "SELECT 'l_returnflag' AS columns, l_returnflag AS \"values\", count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL")(lambda s, d: S.marginals(s.read.parquet(f"{d}/lineitem.parquet"), LI[:2], 1))
register("two_way_marginals", "SELECT 'l_returnflag,l_linestatus' AS columns, l_returnflag || '|' || l_linestatus AS \"values\", count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_returnflag,l_linenumber', l_returnflag || '|' || l_linenumber, count(*) FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus,l_linenumber', l_linestatus || '|' || l_linenumber, count(*) FROM lineitem GROUP BY ALL")(lambda s, d: S.marginals(s.read.parquet(f"{d}/lineitem.parquet"), LI, 2))
register("k_way_combinations", "SELECT 'l_returnflag,l_linestatus,l_linenumber' AS columns, l_returnflag || '|' || l_linestatus || '|' || l_linenumber AS \"values\", count(*) AS n FROM lineitem GROUP BY ALL")(lambda s, d: S.marginals(s.read.parquet(f"{d}/lineitem.parquet"), LI, 3))


@register("covariance_lower", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s_l_quantity, round(sum(l_discount), 2) AS s_l_discount, round(sum(l_quantity * l_quantity), 2) AS p_l_quantity_l_quantity, round(sum(l_discount * l_quantity), 2) AS p_l_discount_l_quantity, round(sum(l_discount * l_discount), 2) AS p_l_discount_l_discount FROM lineitem")
def covariance_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.covariance_sums(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_discount"])
    return out.select("n", *[F.round(c, 2).alias(c) for c in out.columns[1:]])


def _synthetic(name: str, **options) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = spark.read.parquet(f"{d}/lineitem.parquet").select(*LI)
        return Synthesizer.create(name, epsilon=2.0, **options).fit(df, categorical_columns=LI).sample(spark, 1000)

    return run


for _name, _options in (("mwem", {"iterations": 5}), ("mst", {}), ("aim", {}), ("pacsynth", {}), ("quail", {"target": "l_returnflag"})):
    register(f"synth_{_name}")(_synthetic(_name, **_options))
