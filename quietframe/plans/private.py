"""Private queries: bind and check a query, plan its exact stage, and release noisy results exactly once.

The exact stage is a DataFrame: filter, pick and clamp columns, keep at most max_ids rows of each individual, and aggregate. The filter is below the
sampling window, so rows that it drops don't use up an individual's quota. With max_ids 1 the key count is a plain count, since each key has
one row then. The release draws noise on the aggregated rows and writes them to the shared folder, then charges the odometer; HAVING,
ORDER BY, LIMIT and expressions work on what was written, so collecting twice gives the same answer and no noise is drawn again.
"""

from __future__ import annotations

import dataclasses
import functools
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quietframe.functions.render import quote, render, render_select
from quietframe.operators.mechanisms import Mechanism, OdometerHeterogeneous, Privacy, compose
from quietframe.operators.quantiles import Rank, few_groups, percentiles
from quietframe.plans.ast import Binary, Call, Case, Column, Item, Literal, Node, Ranking, Scalar, Select, Star, Table, is_aggregate
from quietframe.plans.metadata import NUMERIC, ColumnInfo, Metadata, TableInfo
from quietframe.plans.parser import parse
from quietframe.sources.readers import Sources
from quietframe.sources.shared import written

VARIANCES, DEVIATIONS = {"VAR", "VARIANCE"}, {"STD", "STDDEV", "STDEV"}


class QueryError(ValueError):
    """The query can't be answered privately."""


@dataclass(frozen=True)
class Measure:
    """A statistic that is aggregated exactly and then gets noise: kind is count, distinct, sum or squares; column "" for all rows."""

    kind: str
    column: str

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.column or 'all'}"


@dataclass
class Plan:
    query: Select
    table: TableInfo
    info: TableInfo
    key: ColumnInfo | None
    groups: list[Node]
    measures: dict[Measure, Mechanism]
    threshold: Mechanism
    outputs: list[Item]
    columns: dict[str, ColumnInfo] = field(default_factory=dict)

    def steps(self, privacy: Privacy) -> list[tuple[float, float]]:
        """What the release spends: one step for the key count and one for each other statistic."""
        return [(m.epsilon, m.delta) for m in self.mechanisms().values()]

    def mechanisms(self) -> dict[str, Mechanism]:
        out = {"keycount": self.threshold} if self.info.censor_dims else {}
        return out | {m.name: mech for m, mech in self.measures.items() if not (self.info.censor_dims and self.is_key_count(m))}

    def is_key_count(self, m: Measure) -> bool:
        """Counting the key's values, or rows under row privacy, is the key count itself."""
        if self.key is None:
            return m == Measure("count", "")
        return m == Measure("distinct", self.key.name)


class Analyzer:
    """Checks a query against the metadata and makes its plan."""

    def __init__(self, metadata: Metadata, privacy: Privacy):
        self.metadata, self.privacy = metadata, privacy

    def plan(self, query: Select | str) -> Plan:
        q = parse(query) if isinstance(query, str) else query
        if len(q.relations) != 1 or not isinstance(q.relations[0], Table):
            raise QueryError("a private query reads exactly one table; joins and subqueries aren't supported")
        if any(True for _ in q.find(Scalar)):
            raise QueryError("subqueries in expressions aren't supported")
        table = self.metadata.find(q.relations[0].parts)
        self.table, self.names = table, {table.name.lower(), (q.relations[0].alias or table.name).lower()}
        keys = table.keys
        if table.row_privacy and keys:
            raise QueryError("a table with row privacy has no key")
        if not table.row_privacy and len(keys) != 1:
            raise QueryError(f"a private table has exactly one key; {table.name} has {len(keys)}")
        self.key = keys[0] if keys else None
        self.measures: dict[Measure, Mechanism] = {}
        if any(isinstance(i.expr, Star) for i in q.items):
            raise QueryError("a private query can't select *")
        names = [i.name for i in q.items if i.name]
        if len({n.lower() for n in names}) < len(names):
            raise QueryError("two columns of the result have one name")
        if not any(is_aggregate(x) for i in q.items for x in i.expr.find(Call)):
            raise QueryError("a private query needs an aggregate")
        if q.distinct or any(True for i in q.items for _ in i.expr.find(Ranking)):
            raise QueryError("DISTINCT and ranking aren't supported in private queries")
        alias = {i.alias.lower(): i.expr for i in q.items if i.alias}
        groups = [alias.get(g.name.lower(), g) if isinstance(g, Column) and self.column(g, False) is None else g for g in q.group]
        for g in groups:
            if any(is_aggregate(x) for x in g.find(Call)):
                raise QueryError("GROUP BY can't hold an aggregate")
            for c in g.find(Column):
                self.column(c)
        if groups and self.key and all(isinstance(g, Column) and self.column(g).name == self.key.name for g in groups):
            raise QueryError("a private query can't group by the key alone")
        if q.where is not None:
            if any(is_aggregate(x) for x in q.where.find(Call)):
                raise QueryError("WHERE can't hold an aggregate")
            for c in q.where.find(Column):
                self.column(c)
        self.groups = groups
        for i in q.items:
            self.check(i.expr)
        threshold = self.privacy.mechanism("threshold", 1, table.max_ids)
        return Plan(q, table, table, self.key, groups, self.measures, threshold, list(q.items), {c.name: c for c in table.columns.values()})

    def column(self, c: Column, must: bool = True) -> ColumnInfo | None:
        found = self.table.find(c.name) if len(c.parts) == 1 or c.parts[-2].lower() in self.names else None
        if found is not None and found.type == "unknown":
            found = None
        if found is None and must:
            raise QueryError(f"unknown column {'.'.join(c.parts)}")
        return found

    def check(self, x: Node, inside: bool = False) -> None:
        if x in self.groups:
            return
        if is_aggregate(x):
            if inside or any(is_aggregate(y) for a in x.args for y in a.find(Call)):
                raise QueryError("aggregates can't be nested")
            self.add(x)
            return
        if isinstance(x, Column):
            raise QueryError(f"{x.name} must be grouped or aggregated" if self.column(x) else "")
        for c in x.children():
            self.check(c)

    def add(self, x: Call) -> None:
        """Registers what an aggregate needs, with its mechanisms."""
        if len(x.args) != 1 or not isinstance(x.args[0], Column | Star):
            raise QueryError(f"the argument of {x.name} must be a column or *")
        arg = x.args[0]
        if x.name in ("MIN", "MAX") or x.name.startswith("PERCENTILE"):
            raise QueryError(f"{x.name} can't be answered privately")
        m = self.table.max_ids
        if isinstance(arg, Star):
            if x.name != "COUNT" or x.distinct:
                raise QueryError("only COUNT takes *")
            self.measures[Measure("count", "")] = self.privacy.mechanism("count", 1, m)
            return
        c = self.column(arg)
        if x.name == "COUNT":
            self.measures[Measure("distinct" if x.distinct or (c is self.key and m == 1) else "count", c.name)] = self.privacy.mechanism("count", 1, m)
            return
        if c.type not in NUMERIC | {"boolean"}:
            raise QueryError(f"{x.name} needs a number; {c.name} is {c.type}")
        if x.distinct:
            raise QueryError(f"{x.name} DISTINCT isn't supported")
        if c is self.key:
            raise QueryError(f"{x.name} of the key isn't supported")
        kind = "sum_int" if c.type in ("int", "boolean") else "sum_float"
        self.measures[Measure("sum", c.name)] = self.privacy.mechanism(kind, c.range_sensitivity, m)
        if x.name != "SUM":
            self.measures[Measure("count", c.name)] = self.privacy.mechanism("count", 1, m)
        if x.name in VARIANCES | DEVIATIONS:
            self.measures[Measure("squares", c.name)] = self.privacy.mechanism(kind, c.range_sensitivity**2 if c.range_sensitivity is not None else None, m)


def sensitivity_of(x: Node, column: Callable[[Column], float | None]) -> float | None:
    """How much one row changes an expression: sums add, products multiply, literals scale, CASE takes the largest branch. None: unbounded or none."""
    match x:
        case Column():
            return column(x)
        case Call(name, args, _) if is_aggregate(x):
            if name == "COUNT":
                return 1
            s = sensitivity_of(args[0], column)
            return s if s is None or name not in VARIANCES | DEVIATIONS else s * s
        case Binary("+" | "-", a, b):
            s = [v for v in (sensitivity_of(a, column), sensitivity_of(b, column)) if v is not None]
            return sum(s) if s else None
        case Binary("*" | "/" | "%" as op, a, b):
            left, right = sensitivity_of(a, column), sensitivity_of(b, column)
            if isinstance(b, Literal) and left is not None:
                return left * abs(b.value) if op == "*" else left / abs(b.value) if op == "/" else abs(b.value)
            if isinstance(a, Literal) and right is not None and op == "*":
                return right * abs(a.value)
            return left * right if left is not None and right is not None else None
        case Case(_, whens, other):
            s = [v for v in (sensitivity_of(y, column) for y in [*[w[1] for w in whens], *([other] if other else [])]) if v is not None]
            return max(s) if s else None
    s = [v for v in (sensitivity_of(c, column) for c in x.children()) if v is not None]
    return max(s) if s else None


def clamp(x: SparkColumn, c: ColumnInfo) -> SparkColumn:
    """Missing values filled, then cut to the bounds. NULL stays NULL: least and greatest would turn it into a bound."""
    if c.missing_value is not None:
        x = F.coalesce(x, F.lit(c.missing_value))
    if c.bounded and c.type in NUMERIC:
        kind = "bigint" if c.type == "int" else "double"
        x = F.when(x < c.lower, F.lit(c.lower).cast(kind)).when(x > c.upper, F.lit(c.upper).cast(kind)).otherwise(x.cast(kind))
    return x


def bound_contribution(df: DataFrame, key: str, most: int, order: SparkColumn | None = None) -> DataFrame:
    """At most `most` rows of each key, chosen at random (by `order` in tests). Spark limits the groups before it shuffles them, so a
    heavy individual is cut early."""
    w = Window.partitionBy(key).orderBy(F.rand() if order is None else order)
    return df.withColumn("row_number_", F.row_number().over(w)).filter(F.col("row_number_") <= most).drop("row_number_")


def exact_stage(plan: Plan, source: DataFrame, order: SparkColumn | None = None) -> DataFrame:
    """keycount (with censoring), group_0.., and one column for each measure: the exact values that get noise."""
    info, q = plan.info, plan.query
    inner = _unqualified(plan)
    df = source.filter(F.expr(render(q.where, inner))) if q.where is not None else source
    used = list(dict.fromkeys(m.column for m in plan.measures if m.column))
    picked = [F.expr(render(g, inner)).alias(f"group_{i}") for i, g in enumerate(plan.groups)]
    picked += [(clamp(F.col(quote(c)), plan.columns[c]) if info.clamp_columns and not plan.columns[c].private_id else F.col(quote(c))).alias(f"value_{k}") for k, c in enumerate(used)]
    if plan.key is not None:
        picked.append(F.col(quote(plan.key.name)).alias("key_"))
    if order is not None:
        picked.append(order.alias("order_"))
    df = df.select(*picked) if picked else df.select(F.lit(1).alias("one_"))
    sampled = plan.key is not None and info.sample_max_ids
    if sampled:
        df = bound_contribution(df, "key_", info.max_ids, F.col("order_") if order is not None else None)
    aggs = []
    # One row for each key after sampling to one: counting rows with a key counts keys, without expanding for distinct.
    one = sampled and info.max_ids == 1
    if info.censor_dims:
        keys = F.count(F.lit(1)) if plan.key is None else F.count("key_") if one else F.countDistinct("key_")
        aggs.append(keys.alias("keycount"))
    for m in plan.measures:
        if info.censor_dims and plan.is_key_count(m):
            continue
        v = F.col(f"value_{used.index(m.column)}") if m.column else None
        if v is not None and plan.columns[m.column].type == "boolean" and m.kind in ("sum", "squares"):
            v = v.cast("bigint")
        if m.kind == "distinct":
            agg = F.count(v) if one and plan.key is not None and m.column == plan.key.name else F.countDistinct(v)
        else:
            agg = F.count(F.lit(1)) if v is None else F.count(v) if m.kind == "count" else F.sum(v) if m.kind == "sum" else F.sum((v * v).cast("double") if plan.columns[m.column].type == "float" else v * v)
        aggs.append(agg.alias(m.name))
    return df.groupBy(*[f"group_{i}" for i in range(len(plan.groups))]).agg(*aggs)


def _unqualified(plan: Plan) -> Callable[[Node], str | None]:
    def name(x: Node) -> str | None:
        return quote(next(n for n in plan.columns if n.lower() == x.name.lower())) if isinstance(x, Column) else None

    return name


def drawn(mech: Mechanism, value: float, whole: bool, source: random.Random) -> float:
    return mech.draw(value, whole, source)


def add_noise(exact: DataFrame, plan: Plan, noise: Callable[[Mechanism, float, bool, random.Random], float] | None = None) -> DataFrame:
    """Noise on every statistic of every row; NULL sums count as zero. A batch function, so that groups stay distributed."""
    mechanisms, draw = plan.mechanisms(), noise or drawn
    whole = {f.name: isinstance(f.dataType, T.LongType | T.IntegerType) for f in exact.schema.fields}

    def noisy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = random.SystemRandom()
        for f in frames:
            for name, mech in mechanisms.items():
                values = f[name].fillna(0)
                f[name] = [draw(mech, v, whole[name], source) for v in values]
                f[name] = f[name].astype("int64" if whole[name] else "float64")
            yield f

    return exact.mapInPandas(noisy, exact.schema)


def without_noise(mech: Mechanism, value: float, whole: bool, source: random.Random) -> float:
    """For tests of everything but the noise."""
    return int(value) if whole else float(value)


def finish(plan: Plan, noisy: DataFrame, censor: bool = True) -> DataFrame:
    """Expressions, HAVING, ORDER BY and LIMIT over noisy statistics."""
    q = plan.query
    name = _over_noisy(plan)
    select = [F.expr(render(i.expr, name)).alias(f"out_{k}") for k, i in enumerate(q.items)]
    df = noisy.select("*", *select)
    alias = {i.name.lower(): k for k, i in enumerate(q.items) if i.name}

    def outer(x: Node) -> str | None:
        """A select expression wins over an alias; anything else must be made of output columns."""
        for k, i in enumerate(q.items):
            if x == i.expr:
                return f"out_{k}"
        if isinstance(x, Column):
            if x.name.lower() in alias and len(x.parts) == 1:
                return f"out_{alias[x.name.lower()]}"
            if x in plan.groups:
                return f"group_{plan.groups.index(x)}"
            raise QueryError(f"{x.name} isn't a column of the result")
        if is_aggregate(x):
            raise QueryError(f"{x.name} isn't in the SELECT list")
        return None

    if q.having is not None:
        test = render(q.having, outer)
        df = df.filter(F.expr(f"CAST({test} AS boolean)"))
    if q.order:
        df = df.orderBy(*[F.expr(render(e, outer)).desc() if d else F.expr(render(e, outer)).asc() for e, d in q.order])
    if q.limit is not None:
        df = df.limit(q.limit)
    names, taken = [], set()
    for k, i in enumerate(q.items):
        n = i.name or (f"{i.expr.name.lower()}_{k}" if isinstance(i.expr, Call) else f"expression_{k}")
        names.append(n)
        taken.add(n)
    return df.select(*[F.col(f"out_{k}").alias(n) for k, n in enumerate(names)])


def _over_noisy(plan: Plan) -> Callable[[Node], str | None]:
    """Aggregates as columns of the noisy table: AVG is a quotient; variances are cut at zero."""

    def measure(m: Measure) -> str:
        return "keycount" if plan.info.censor_dims and plan.is_key_count(m) else quote(m.name)

    def name(x: Node) -> str | None:
        if x in plan.groups:
            return f"group_{plan.groups.index(x)}"
        if not is_aggregate(x):
            return None
        arg = x.args[0]
        if isinstance(arg, Star):
            return measure(Measure("count", ""))
        column = next(n for n in plan.columns if n.lower() == arg.name.lower())
        count = measure(Measure("distinct", column) if Measure("distinct", column) in plan.measures and (x.distinct or Measure("count", column) not in plan.measures) else Measure("count", column))
        if x.name == "COUNT":
            return count
        total = measure(Measure("sum", column))
        if x.name == "SUM":
            return total
        mean = f"(CASE WHEN {count} = 0 THEN 0D ELSE CAST({total} AS double) / {count} END)"
        if x.name == "AVG":
            return mean
        square = measure(Measure("squares", column))
        var = f"greatest(0D, (CASE WHEN {count} = 0 THEN 0D ELSE CAST({square} AS double) / {count} END) - {mean} * {mean})"
        return var if x.name in VARIANCES else f"sqrt({var})"

    return name


class PrivateSession:
    """Answers SQL over private tables, and keeps the account. `tables` are public names to DataFrames or pandas frames."""

    def __init__(self, spark: SparkSession, metadata: Metadata | dict | str, privacy: Privacy | None = None, tables: dict | None = None, cap: float | None = None):
        self.spark, self.metadata, self.privacy = spark, Metadata.of(metadata), privacy or Privacy()
        self.sources = tables if isinstance(tables, Sources) else Sources(spark, tables)
        self.odometer = OdometerHeterogeneous(self.privacy, cap=cap)

    def plan(self, query: str | Select) -> Plan:
        return Analyzer(self.metadata, self.privacy).plan(query)

    def exact(self, query: str | Select, order: SparkColumn | None = None) -> DataFrame:
        """The exact stage alone. It isn't private; for tests and for `pre_aggregated`."""
        p = self.plan(query)
        return exact_stage(p, self.sources.frame(p.query.relations[0].parts), order)

    def execute(self, query: str | Select, *, pre_aggregated: DataFrame | pd.DataFrame | Sequence | None = None, postprocess: bool = True, order: SparkColumn | None = None, noise=None) -> DataFrame:
        """The released result, or with postprocess=False the noisy statistics behind it. pre_aggregated: the exact stage's rows, as a frame, or as
        a list or array of records of which the first holds the names."""
        p = self.plan(query)
        steps = p.steps(self.privacy)
        self.odometer.check(steps)
        if pre_aggregated is None:
            exact = exact_stage(p, self.sources.frame(p.query.relations[0].parts), order)
        else:
            if not isinstance(pre_aggregated, DataFrame | pd.DataFrame):
                names, *records = [list(r) for r in pre_aggregated]
                if not records:
                    raise QueryError("pre-aggregated records must be names and then rows")
                pre_aggregated = pd.DataFrame([[x.item() if hasattr(x, "item") else x for x in r] for r in records], columns=[str(c) for c in names])
            exact = self.spark.createDataFrame(pre_aggregated) if isinstance(pre_aggregated, pd.DataFrame) else pre_aggregated
            wanted = [*[f"group_{i}" for i in range(len(p.groups))], *p.mechanisms()]
            if sorted(exact.columns) != sorted(wanted):
                raise QueryError(f"pre-aggregated columns are {exact.columns}; the query needs {wanted}")
        noisy = add_noise(exact, p, noise)
        if p.info.censor_dims:
            noisy = noisy.filter(F.col("keycount") > p.threshold.threshold)
        if p.info.clamp_counts:
            counts = ["keycount"] * p.info.censor_dims + [m.name for m in p.measures if m.kind in ("count", "distinct") and m.name in exact.columns]
            noisy = noisy.withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in counts})
        released = written(noisy, "release")
        for s in steps:
            self.odometer.spend(s)
        return finish(p, released) if postprocess else released

    def cost(self, query: str | list[str]) -> tuple[float, float]:
        """What the queries would spend together; nothing is charged."""
        steps = [s for q in ([query] if isinstance(query, str) else query) for s in self.plan(q).steps(self.privacy)]
        return compose(steps, self.odometer.tolerance)

    def accuracy(self, query: str, alpha: float) -> list[float | None]:
        """For each column the half-width that noise stays in with probability 1 - alpha; None for what isn't a plain COUNT or SUM."""
        p, out = self.plan(query), []
        for i in p.query.items:
            x = i.expr
            mech = None
            if is_aggregate(x) and x.name in ("COUNT", "SUM"):
                arg = x.args[0]
                column = "" if isinstance(arg, Star) else next(n for n in p.columns if n.lower() == arg.name.lower())
                kinds = ("sum",) if x.name == "SUM" else ("distinct",) if x.distinct else ("count", "distinct")
                mech = next((p.measures[m] for k in kinds if (m := Measure(k, column)) in p.measures), None)
            out.append(mech.accuracy(alpha) if mech else None)
        return out


def read(spark: SparkSession, query: str | Select, sources: Sources | dict) -> DataFrame:
    """A query over public tables: every join, subqueries, ranking, DISTINCT, MIN, MAX and percentiles. Catalyst optimizes it."""
    q = parse(query) if isinstance(query, str) else query
    src = sources if isinstance(sources, Sources) else Sources(spark, sources)
    frames: dict[str, DataFrame] = {}
    made: dict[tuple[str, ...], DataFrame] = {}

    def table(t: Table) -> str:
        view = "t_" + "_".join(t.parts).lower().replace(" ", "_")
        frames[view] = made[t.parts] if t.parts in made else src.frame(t.parts)
        return "{" + view + "}" + ("" if t.alias else f" AS {quote(t.parts[-1])}")

    def run(q: Select) -> DataFrame:
        text = render_select(q, table=table)
        return spark.sql(text, **frames)

    q = _escaped(q)
    mended = _percentiles_beside(q, run, made)
    return run(mended).toDF(*run(q).columns) if made else run(q)


def _percentiles_beside(q: Select, run: Callable[[Select], DataFrame], made: dict[tuple[str, ...], DataFrame]) -> Select:
    """The query with its percentiles, and those of queries that it reads from, from tables beside the others, which are put into made: a row for
    each group, from operators.quantiles. Left as they are: percentiles of small groups, in scalar subqueries and of what gives other rows each time."""

    def walk(x, f: Callable[[Node], Node | None]):
        if isinstance(x, Node):
            if (y := f(x)) is not None:
                return y
            return dataclasses.replace(x, **{c.name: walk(getattr(x, c.name), f) for c in dataclasses.fields(x)})
        return tuple(walk(y, f) for y in x) if isinstance(x, tuple) else x

    def own(x, f: Callable[[Node], Node | None]):
        return walk(x, lambda n: n if isinstance(n, Select) else f(n))

    q = dataclasses.replace(q, relations=walk(q.relations, lambda n: n if isinstance(n, Scalar) else _percentiles_beside(n, run, made) if isinstance(n, Select) else None))
    calls: dict[Call, str] = {}
    own((q.items, q.having, q.order), lambda n: calls.setdefault(n, f"p{len(calls)}") and n if isinstance(n, Call) and n.name.startswith("PERCENTILE_") and len(n.args) == 2 else None)
    if not calls or not q.relations:
        return q

    def key(g: Node) -> Node:
        """What a group is by: a number or a name may stand for an item, a name only where no column has it."""
        if isinstance(g, Literal) and type(g.value) is int and 1 <= g.value <= len(q.items):
            return q.items[g.value - 1].expr
        item = next((i.expr for i in q.items if isinstance(g, Column) and len(g.parts) == 1 and i.alias and i.alias.lower() == g.name.lower()), None)
        if item is not None:
            try:
                run(Select((Item(g),), q.relations))
            except AnalysisException:
                return item
        return g

    try:
        keys = [key(g) for g in q.group]
        base = run(Select((*[Item(k, f"g{i}") for i, k in enumerate(keys)], *[Item(c.args[0], f"v{i}") for i, c in enumerate(calls)]), q.relations, q.where))
        if not base._jdf.queryExecution().analyzed().deterministic():
            return q
        ranks = {n: Rank(f"v{i}", render(c.args[1]), c.name == "PERCENTILE_DISC") for i, (c, n) in enumerate(calls.items())}
        by = [f"g{i}" for i in range(len(keys))]
        if (few := few_groups(base, by)) is None:
            return q
        found = percentiles(base, ranks, by, few)
    except AnalysisException:
        return q  # it is wrong, which the query itself will say
    name = f"percentiles {len(made)}"
    made[(name,)] = F.broadcast(found) if few else found
    tests = [Binary("<=>", k, Column((name, f"g{i}"))) for i, k in enumerate(keys)]
    where = functools.reduce(lambda a, b: Binary("AND", a, b), [*([q.where] if q.where is not None else []), *tests]) if tests or q.where is not None else None
    put = {f: own(getattr(q, f), lambda n: Call("MAX", (Column((name, calls[n])),)) if n in calls else None) for f in ("items", "having", "order")}
    return dataclasses.replace(q, relations=(*q.relations, Table((name,))), where=where, **put)


def _escaped(q: Select) -> Select:
    """Braces in literals are doubled, since spark.sql formats its text."""

    def walk(x):
        if isinstance(x, Literal) and isinstance(x.value, str):
            return Literal(x.value.replace("{", "{{").replace("}", "}}"))
        if isinstance(x, Node):
            return dataclasses.replace(x, **{f.name: walk(getattr(x, f.name)) for f in dataclasses.fields(x)})
        return tuple(map(walk, x)) if isinstance(x, tuple) else x

    return walk(q)
