"""Reversible column transforms. fit() looks at data (privately where it needs a budget); transform() and inverse() are column expressions."""

from __future__ import annotations

import re
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietframe.operators.bounds import approx_bounds
from quietframe.operators.mechanisms import Laplace


class Transformer:
    """One input column to `width` output columns and back."""

    width, cardinality, needs_epsilon = 1, [None], False

    def fit(self, df: DataFrame, column: str, epsilon: float = 0.0) -> Transformer:
        return self

    def transform(self, x: Column) -> list[Column]:
        raise NotImplementedError

    def inverse(self, cols: list[Column]) -> Column | None:
        raise NotImplementedError


class Identity(Transformer):
    def transform(self, x):
        return [x]

    def inverse(self, cols):
        return cols[0]


class Label(Transformer):
    """Sorted distinct values become 0..k-1; NULL is last when nullable. The values come to the driver, at most `most` of them."""

    def __init__(self, nullable: bool = True, most: int = 10_000):
        self.nullable, self.most, self.values = nullable, most, []

    def fit(self, df, column, epsilon=0.0):
        rows = df.select(F.col(column).alias("v")).filter("v IS NOT NULL").distinct().orderBy("v").limit(self.most + 1).collect()
        if len(rows) > self.most:
            raise ValueError(f"{column} has more than {self.most} values")
        self.values = [r["v"] for r in rows]
        self.cardinality = [len(self.values) + self.nullable]
        return self

    def transform(self, x):
        at = F.array_position(F.array(*map(F.lit, self.values)), x) - 1 if self.values else F.lit(-1)
        at = F.when(at >= 0, at)
        return [(F.when(x.isNull(), len(self.values)).otherwise(at) if self.nullable else at).cast("int")]

    def inverse(self, cols):
        return F.get(F.array(*map(F.lit, self.values)), cols[0].cast("int")) if self.values else F.lit(None)


class OneHot(Transformer):
    """A label to a 0/1 vector; a single label is one column of 1."""

    def fit(self, df, column, epsilon=0.0):
        self.width = int(df.agg(F.max(column)).first()[0] or 0) + 1
        self.cardinality = [2] * self.width
        return self

    def transform(self, x):
        return [(x == i).cast("int") for i in range(self.width)]

    def inverse(self, cols):
        return F.array_position(F.array(*cols), F.array_max(F.array(*cols))) - 1


class _Bounded(Transformer):
    def __init__(self, *, lower=None, upper=None, epsilon: float = 0.0, nullable: bool = False, odometer=None):
        self.lower, self.upper, self.epsilon, self.nullable, self.odometer = lower, upper, epsilon, nullable, odometer

    @property
    def needs_epsilon(self):
        return self.lower is None or self.upper is None

    def bounds(self, df, column, epsilon):
        if self.needs_epsilon:
            eps = self.epsilon or epsilon
            if not eps > 0:
                raise ValueError(f"{column} needs bounds or a budget")
            lo, hi = approx_bounds(df, column, eps, self.odometer)
            if lo is None:
                raise ValueError(f"no bounds of {column} could be found")
            self.lower, self.upper = lo if self.lower is None else self.lower, hi if self.upper is None else self.upper

    def clamped(self, x):
        return F.when(x < self.lower, F.lit(float(self.lower))).when(x > self.upper, F.lit(float(self.upper))).otherwise(x.cast("double"))


class MinMax(_Bounded):
    """Clamped and scaled to [-1, 1] or [0, 1]. Nullable: a pair of value and mark, (0, 1) for NULL."""

    def __init__(self, *, negative: bool = True, **kw):
        super().__init__(**kw)
        self.negative = negative
        self.width = 1 + self.nullable
        self.cardinality = [None, 2][: self.width]

    def fit(self, df, column, epsilon=0.0):
        self.bounds(df, column, epsilon)
        return self

    def transform(self, x):
        span = (self.upper - self.lower) or 1.0
        y = (self.clamped(x) - self.lower) / span
        y = y * 2 - 1 if self.negative else y
        return [F.coalesce(y, F.lit(0.0)), x.isNull().cast("int")] if self.nullable else [y]

    def inverse(self, cols):
        y = (cols[0] + 1) / 2 if self.negative else cols[0]
        out = self.clamped(y * (self.upper - self.lower) + self.lower)
        return F.when(cols[1] == 1, None).otherwise(out) if self.nullable else out


class Bin(_Bounded):
    """Equal bins; the value back is the bin's middle. NULL is the bin after the last."""

    def __init__(self, *, bins: int = 10, **kw):
        super().__init__(**kw)
        self.bins = bins
        self.cardinality = [bins + self.nullable]

    def fit(self, df, column, epsilon=0.0):
        self.bounds(df, column, epsilon)
        return self

    def transform(self, x):
        at = F.least(F.lit(self.bins - 1), F.floor(self.bins * (self.clamped(x) - self.lower) / ((self.upper - self.lower) or 1.0))).cast("int")
        at = F.when(x.isNotNull(), at)
        return [F.coalesce(at, F.lit(self.bins)) if self.nullable else at]

    def inverse(self, cols):
        middle = self.lower + (cols[0] + 0.5) * (self.upper - self.lower) / self.bins
        return F.when(cols[0] < self.bins, middle) if self.nullable else middle


class Standard(_Bounded):
    """(x - mean) / deviation, both private: 80% of the budget for the variance, 20% for the mean, after half for bounds that are missing."""

    def fit(self, df, column, epsilon=0.0):
        eps = self.epsilon or epsilon
        if not eps > 0:
            raise ValueError(f"{column} needs a budget")
        if self.needs_epsilon:
            self.bounds(df, column, eps / 2)
            eps /= 2
        x = self.clamped(F.col(column))
        n, s, q = df.agg(F.count(x), F.sum(x), F.sum(x * x)).first()
        n, width = max(1, n), self.upper - self.lower
        draw = lambda value, reach, e: Laplace(e, 0.0, max(reach, 1e-9)).release([value])[0]
        self.mean = draw((s or 0) / n, width / n, eps * 0.2)
        var = draw((q or 0) / n - ((s or 0) / n) ** 2, width**2 / n, eps * 0.8)
        self.deviation = min(max(var, 0.001), max(width**2 / 4, 0.001)) ** 0.5
        if self.odometer is not None:
            self.odometer.spend((eps, 0.0))
        self.width = 1 + self.nullable
        self.cardinality = [None, 2][: self.width]
        return self

    needs_epsilon = True

    def bounds(self, df, column, epsilon):
        if self.lower is None or self.upper is None:
            super().bounds(df, column, epsilon)

    def transform(self, x):
        y = (self.clamped(x) - self.mean) / self.deviation
        return [F.coalesce(y, F.lit(0.0)), x.isNull().cast("int")] if self.nullable else [y]

    def inverse(self, cols):
        out = self.clamped(cols[0] * self.deviation + self.mean)
        return F.when(cols[1] == 1, None).otherwise(out) if self.nullable else out


class Clamp(Transformer):
    def __init__(self, upper=None, lower=None):
        if upper is None and lower is None:
            raise ValueError("clamp needs a bound")
        self.upper, self.lower = upper, lower

    def _cut(self, x):
        y = x
        if self.lower is not None:
            y = F.when(x < self.lower, self.lower).otherwise(y)
        return F.when(x > self.upper, self.upper).otherwise(y) if self.upper is not None else y

    def transform(self, x):
        return [self._cut(x)]

    def inverse(self, cols):
        return self._cut(cols[0])


class Log(Transformer):
    def transform(self, x):
        return [F.ln(x)]

    def inverse(self, cols):
        return F.exp(cols[0])


#: The date and time texts that are read. A time without a date is one of the first of January 1970.
FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd hh:mm:ss[.SSSSSS] a",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX][XX]",
    "HH:mm:ss[.SSSSSS]",
    "MM/dd/yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "dd.MM.yyyy",
    "yyyy/MM/dd",
    "yyyyMMdd",
)


class DateTime(Transformer):
    """Days since the epoch, with a fraction. Text is tried in each of FORMATS."""

    def __init__(self, epoch: str = "1970-01-01"):
        self.epoch, self.kind = epoch, "timestamp"

    def fit(self, df, column, epsilon=0.0):
        self.kind = dict(df.dtypes)[column]
        return self

    def transform(self, x):
        t = F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in FORMATS]) if self.kind == "string" else x.cast("timestamp")
        return [(F.unix_micros(t) - F.unix_micros(F.lit(self.epoch).cast("timestamp"))) / 86_400_000_000.0]

    def inverse(self, cols):
        t = F.timestamp_micros((F.round(cols[0] * 86_400_000_000.0) + F.unix_micros(F.lit(self.epoch).cast("timestamp"))).cast("bigint"))
        return F.date_format(t, "yyyy-MM-dd HH:mm:ss") if self.kind == "string" else t.cast(self.kind)


class Chain(Transformer):
    """Transforms in turn; all but the last have one output."""

    def __init__(self, transformers: list[Transformer]):
        self.parts = transformers

    @property
    def needs_epsilon(self):
        return any(p.needs_epsilon for p in self.parts)

    def fit(self, df, column, epsilon=0.0):
        each = epsilon / max(1, sum(p.needs_epsilon for p in self.parts))
        for p in self.parts:
            p.fit(df, column, each)
            if p is not self.parts[-1]:
                df = df.withColumn(column, p.transform(F.col(column))[0])
        self.width, self.cardinality = self.parts[-1].width, self.parts[-1].cardinality
        return self

    def transform(self, x):
        for p in self.parts[:-1]:
            x = p.transform(x)[0]
        return self.parts[-1].transform(x)

    def inverse(self, cols):
        x = self.parts[-1].inverse(cols)
        for p in reversed(self.parts[:-1]):
            x = p.inverse([x])
        return x


class Drop(Transformer):
    width, cardinality = 0, []

    def transform(self, x):
        return []

    def inverse(self, cols):
        return None


def _fake(kind: str):
    @F.pandas_udf("string")
    def make(seed: pd.Series) -> pd.Series:
        def one(_):
            u = uuid.uuid4()
            n = u.int
            if kind == "email":
                return f"user{n % 10**8}@example.org"
            if kind == "ssn":
                return f"{n % 900:03d}-{n // 1000 % 99 + 1:02d}-{n // 10**6 % 9999 + 1:04d}"
            return str(u) if kind == "uuid4" else f"2{n % 1000:03d}-{n // 1000 % 12 + 1:02d}-{n // 10**5 % 28 + 1:02d}" if kind == "datetime" else f"name{n % 10**6}"

        return seed.map(one)

    return make.asNondeterministic()


class Anonymization(Drop):
    """Takes a column of personal data out; a new made-up value of its kind stands in the result. `fake`: a kind, or a function that makes one."""

    def __init__(self, fake):
        self.fake = fake

    def inverse(self, cols):
        if callable(self.fake):
            make = self.fake
            return F.pandas_udf(lambda s: s.map(lambda _: str(make())), "string").asNondeterministic()(F.monotonically_increasing_id())
        return _fake(self.fake)(F.monotonically_increasing_id())


class TableTransformer:
    """A transformer for each column; the budget is split evenly over those that need one."""

    def __init__(self, transformers: dict[str, Transformer], odometer=None):
        self.by, self.odometer = transformers, odometer

    def fit(self, df: DataFrame, epsilon: float = 0.0) -> TableTransformer:
        each = epsilon / max(1, sum(bool(t.needs_epsilon) for t in self.by.values()))
        for c, t in self.by.items():
            t.fit(df, c, each)
        return self

    @property
    def cardinality(self) -> list[int | None]:
        return [n for t in self.by.values() for n in t.cardinality]

    def names(self) -> list[str]:
        return [f"{c}_{i}" if t.width > 1 else c for c, t in self.by.items() for i in range(t.width)]

    def transform(self, df: DataFrame) -> DataFrame:
        cols = [x for c, t in self.by.items() for x in t.transform(F.col(c))]
        return df.select(*[x.alias(n) for x, n in zip(cols, self.names(), strict=True)])

    def inverse(self, df: DataFrame) -> DataFrame:
        out = []
        for c, t in self.by.items():
            cols = [F.col(f"{c}_{i}") for i in range(t.width)] if t.width > 1 else [F.col(c)] * t.width
            if (x := t.inverse(cols)) is not None:
                out.append(x.alias(c))
        return df.select(*out)

    @classmethod
    def create(cls, df: DataFrame, style: str = "gan", *, nullable: bool = False, categorical_columns=(), ordinal_columns=(), continuous_columns=(), constraints: dict | None = None) -> TableTransformer:
        """From the kinds of columns, inferred where none is given. Styles: gan (one-hot, scaled) and cube (labels, bins)."""
        if not (categorical_columns or ordinal_columns or continuous_columns):
            kinds = infer_column_types(df)
            categorical_columns, ordinal_columns, continuous_columns = kinds["categorical"], kinds["ordinal"], kinds["continuous"]
            special = {c: Anonymization(k) for c, k in kinds["pii"].items()}
        else:
            special = {}
        by: dict[str, Transformer] = {}
        for c in df.columns:
            if c in (constraints or {}):
                by[c] = Drop() if constraints[c] == "drop" else constraints[c]
            elif c in special:
                by[c] = special[c]
            elif c in categorical_columns or c in ordinal_columns:
                by[c] = Chain([Label(nullable), OneHot()]) if style == "gan" else Label(nullable)
            elif c in continuous_columns:
                by[c] = MinMax(nullable=nullable) if style == "gan" else Bin(bins=20, nullable=nullable)
        return cls(by)


class NoTransformer(TableTransformer):
    """Every column as it is."""

    def __init__(self, odometer=None):
        super().__init__({}, odometer)

    def fit(self, df: DataFrame, epsilon: float = 0.0) -> TableTransformer:
        self.by = {c: Identity() for c in df.columns}
        return super().fit(df, epsilon)


#: Patterns of personal data.
PII = {"datetime": r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?$", "uuid4": r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "ssn": r"^\d{3}-\d{2}-\d{4}$"}


def infer_pii(values: list[str]) -> str | None:
    values = [v for v in values if v is not None]
    return next((k for k, p in PII.items() if values and all(re.match(p, str(v)) for v in values)), None)


def is_ids(values: list[int]) -> bool:
    """Whether numbers look like a sequence of ids: distinct, and a run but for order."""
    v = sorted(x for x in values if x is not None)
    return len(v) > 1 and len(set(v)) == len(v) and v[-1] - v[0] == len(v) - 1


def infer_column_types(df: DataFrame, rows: int = 1000) -> dict:
    """Kinds of columns by up to `rows` rows."""
    sample = df.limit(rows).toPandas()
    out: dict = {"categorical": [], "ordinal": [], "continuous": [], "pii": {}}
    for c, t in df.dtypes:
        v = sample[c].dropna().tolist()
        if t == "boolean":
            out["categorical"].append(c)
        elif t == "string":
            kind = infer_pii(v)
            out["pii"].update({c: kind}) if kind else out["categorical"].append(c)
        elif t in ("tinyint", "smallint", "int", "bigint") or t in ("float", "double") and v and all(float(x).is_integer() for x in v):
            few = bool(v) and len(set(v)) < 150 and max(v) - min(v) < 150
            out["ordinal" if few else "continuous"].append(c)
        elif t in ("float", "double") or t.startswith("decimal"):
            out["continuous"].append(c)
        elif t in ("date", "timestamp", "timestamp_ntz"):
            out["continuous"].append(c)
    return out


def total_width(parts: list[Transformer]) -> int:
    return reduce(lambda a, t: a + t.width, parts, 0)
