"""Private synthesizers on integer-coded tables, private covariance and regression.

A fit reads exact marginals (Spark aggregates), adds noise once on the driver, and keeps a model of bounded size. A sample of n rows is made
by Spark: each row walks the model with its own random numbers, so sampling is distributed.
"""

from __future__ import annotations

import math
import random
import warnings
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietframe.operators.mechanisms import Laplace, discrete_laplace, rho_of
from quietframe.synth.marginals import covariance_sums, occurring, table, tables
from quietframe.transform.columns import TableTransformer


def _rng() -> np.random.Generator:
    return np.random.default_rng(random.SystemRandom().getrandbits(128))


def exponential_mechanism(scores: Sequence[float], epsilon: float, sensitivity: float = 1.0, rng: np.random.Generator | None = None) -> int:
    """The index of an option, likelier by exp(epsilon score / 2 sensitivity)."""
    x = np.asarray(scores, float) * epsilon / (2 * sensitivity)
    p = np.exp(x - x.max())
    return int((rng or _rng()).choice(len(p), p=p / p.sum()))


def _laplace(x: np.ndarray, scale: float) -> np.ndarray:
    source = random.SystemRandom()
    return x + np.array([discrete_laplace(scale, source) for _ in range(x.size)]).reshape(x.shape)


def _gauss(x: np.ndarray, sigma: float) -> np.ndarray:
    source = random.SystemRandom()
    return x + np.array([round(source.gauss(0, sigma)) for _ in range(x.size)]).reshape(x.shape)


class Synthesizer:
    """fit, sample, fit_sample and sample_conditional over DataFrames."""

    style = "cube"

    def __init__(self, epsilon: float = 1.0, **options):
        self.epsilon, self.options, self.spent = epsilon, options, 0.0

    @staticmethod
    def create(name: str, epsilon: float = 1.0, **options) -> Synthesizer:
        if name not in SYNTHESIZERS:
            raise ValueError(f"unknown synthesizer {name}; known: {sorted(SYNTHESIZERS)}")
        return SYNTHESIZERS[name](epsilon=epsilon, **options)

    def fit(self, df: DataFrame, *, transformer: TableTransformer | None = None, categorical_columns=(), ordinal_columns=(), continuous_columns=(), preprocessor_eps: float = 0.0, nullable: bool = False) -> Synthesizer:
        self.transformer = transformer or TableTransformer.create(df, self.style, nullable=nullable, categorical_columns=categorical_columns, ordinal_columns=ordinal_columns, continuous_columns=continuous_columns)
        needs = any(t.needs_epsilon for t in self.transformer.by.values())
        if needs and not 0 < preprocessor_eps < self.epsilon:
            raise ValueError("columns without bounds need a part of the budget: preprocessor_eps")
        self.transformer.fit(df, preprocessor_eps)
        self.spent = preprocessor_eps if needs else 0.0
        coded = self.transformer.transform(df)
        self.columns, self.shape = coded.columns, [int(n) for n in self.transformer.cardinality]
        self.learn(coded, self.epsilon - self.spent)
        self.spent = self.epsilon
        return self

    def learn(self, df: DataFrame, epsilon: float) -> None:
        raise NotImplementedError

    def rows(self, n: int, rng: np.random.Generator) -> np.ndarray:
        """n coded rows; runs on executors."""
        raise NotImplementedError

    def sample(self, spark: SparkSession, n: int, seed: int | None = None) -> DataFrame:
        columns, draw = self.columns, self.rows
        base = random.SystemRandom().getrandbits(60) if seed is None else seed

        def make(frames):
            for f in frames:
                rng = np.random.default_rng([base, int(f["id"].iloc[0])]) if len(f) else None
                if rng is not None:
                    yield pd.DataFrame(draw(len(f), rng), columns=columns).astype("int64")

        coded = spark.range(n).mapInPandas(make, ", ".join(f"`{c}` long" for c in columns))
        return self.transformer.inverse(coded)

    def fit_sample(self, df: DataFrame, **kw) -> DataFrame:
        n = df.count()
        return self.fit(df, **kw).sample(df.sparkSession, n)

    def sample_conditional(self, spark: SparkSession, n: int, condition: str, max_tries: int = 100) -> DataFrame:
        """n rows that fit a condition, by rejection; batches grow as few fit. Each batch has a seed, so that it stays what was counted."""
        out, have, size = None, 0, n
        for _ in range(max_tries):
            part = self.sample(spark, size, seed=random.SystemRandom().getrandbits(60)).filter(condition)
            got = part.count()
            out, have = part if out is None else out.unionByName(part), have + got
            if have >= n:
                return out.limit(n)
            size = min(10_000_000, int(size * 2 if not got else math.ceil((n - have) * size / got * 1.2)))
        raise ValueError(f"only {have} of {n} rows fit after {max_tries} tries")


class MWEM(Synthesizer):
    """Multiplicative weights with the exponential mechanism (Hardt, Ligett, McSherry 2012) over marginal queries, on the joint histogram of
    each group of columns (`split_factor` columns a group). `q_count` adds that many random boxes, a range of each of up to `box_width` columns."""

    def learn(self, df, epsilon):
        k = self.options.get("split_factor") or len(self.columns)
        groups = [list(range(i, min(i + k, len(self.columns)))) for i in range(0, len(self.columns), k)]
        self.parts, rng = [], _rng()
        for g in groups:
            true = table(df, [self.columns[i] for i in g], [self.shape[i] for i in g])
            total = max(1.0, float(_laplace(np.array([true.sum()]), 20 / epsilon * len(groups))[0]))
            rounds = self.options.get("iterations") or max(1, math.ceil(10 * math.log10(max(10, true.size))) // 4)
            each = epsilon * 0.95 / len(groups) / rounds / 2
            width = min(self.options.get("marginal_width", 2), len(g))
            queries = [c for w in range(1, width + 1) for c in combinations(range(len(g)), w)]
            queries += [self._box(true.shape, self.options.get("box_width", len(g)), rng) for _ in range(self.options.get("q_count", 0))]
            model = np.full(true.shape, total / true.size)
            seen: list[tuple] = []
            for _ in range(rounds):
                errors = [np.abs(self._sum(true, q) - self._sum(model, q)).sum() for q in queries]
                q = queries[exponential_mechanism(errors, each, 1.0, rng)]
                seen.append((q, _laplace(self._sum(true, q), 1 / each)))
                for _ in range(self.options.get("mult_weights_iterations", 20)):
                    for q2, m in seen:
                        now = self._sum(model, q2)
                        step = np.exp(np.clip((m - now) / (2 * total), -5, 5))
                        if isinstance(q2[0], slice):
                            model[q2] *= step
                        else:
                            model = model * np.expand_dims(step, tuple(i for i in range(model.ndim) if i not in q2))
                        model *= total / model.sum()
            p = model.ravel() / model.sum()
            self.parts.append((g, model.shape, np.cumsum(p)))

    @staticmethod
    def _box(shape: Sequence[int], width: int, rng: np.random.Generator) -> tuple[slice, ...]:
        some = set(rng.permutation(len(shape))[: rng.integers(1, max(1, min(width, len(shape))) + 1)].tolist())
        ends = [sorted(rng.integers(0, n, 2).tolist()) for n in shape]
        return tuple(slice(a, b + 1) if i in some else slice(None) for i, (a, b) in enumerate(ends))

    @staticmethod
    def _sum(x: np.ndarray, axes: tuple) -> np.ndarray:
        """The marginal over some axes, or the count in a box of slices."""
        if isinstance(axes[0], slice):
            return np.asarray(x[axes].sum())
        return x.sum(axis=tuple(i for i in range(x.ndim) if i not in axes))

    def rows(self, n, rng):
        out = np.zeros((n, len(self.columns)), np.int64)
        for g, shape, cdf in self.parts:
            cell = np.minimum(np.searchsorted(cdf, rng.random(n)), len(cdf) - 1)
            for i, v in zip(g, np.unravel_index(cell, shape), strict=True):
                out[:, i] = v
        return out


class MST(Synthesizer):
    """A tree of noisy two-way marginals: a third of the zCDP budget on one-way marginals, a third on choosing edges (maximum spanning tree by the
    exponential mechanism on the error of independence), a third on measuring them. Between the first two, values whose noisy count is under three
    standard deviations become one, which sampling gives back as any of them alike. Sampling walks the tree from its root."""

    def learn(self, df, epsilon):
        rho = rho_of(epsilon, self.options.get("delta", 1e-9)) / 3
        d, rng = len(self.columns), _rng()
        sigma = math.sqrt(d / (2 * rho))
        noisy = [_gauss(x, sigma) for x in tables(df, self.columns, self.shape, [(i,) for i in range(d)])]
        self.compress(noisy, sigma, 3 * sigma)
        total = max(1.0, float(np.mean([o.sum() for o in self.ones])))
        true = dict(zip(combinations(range(d), 2), tables(df, self.columns, self.size, list(combinations(range(d), 2)), self.maps), strict=True))
        edges = self.choose(true, rho, total, rng) if d > 1 else []
        sigma = math.sqrt(max(1, len(edges)) / (2 * rho))
        seen = {e: _gauss(true[e], sigma) for e in edges}
        for e, x in seen.items():
            self.blend(e, x, sigma)
        self.grow(edges, {e: _positive(x) for e, x in seen.items()})

    def compress(self, noisy: list[np.ndarray], sigma: float, least: float) -> None:
        """ones and their precision, size, maps (new codes of columns with rare values), back (old values of each new code)."""
        self.ones, self.sure, self.size, self.maps, self.back = [], [], [], {}, []
        for i, x in enumerate(noisy):
            rare = np.flatnonzero(x < least)
            often = np.flatnonzero(x >= least)
            if len(rare) < 2 or not len(often):
                self.back.append([np.array([v]) for v in range(len(x))])
                self.ones.append(_positive(x))
                self.sure.append(np.full(len(x), 1 / sigma**2))
            else:
                code = np.full(len(x), len(often))
                code[often] = np.arange(len(often))
                self.maps[i] = code.tolist()
                self.back.append([*(np.array([v]) for v in often), rare])
                self.ones.append(_positive(np.append(x[often], max(0.0, x[rare].sum()))))
                self.sure.append(np.append(np.full(len(often), 1 / sigma**2), 1 / (sigma**2 * len(rare))))
            self.size.append(len(self.ones[-1]))

    def blend(self, e: tuple[int, int], seen: np.ndarray, sigma: float) -> None:
        """The one-way marginals of a pair, averaged by precision with the sums of its noisy table."""
        for axis, i in ((1, e[0]), (0, e[1])):
            p = 1 / (sigma**2 * seen.shape[axis])
            self.ones[i] = _positive((self.ones[i] * self.sure[i] + seen.sum(axis) * p) / (self.sure[i] + p))
            self.sure[i] = self.sure[i] + p

    def grow(self, edges: list[tuple[int, int]], pairs: dict[tuple[int, int], np.ndarray]) -> None:
        """The walk: the root by its own marginal, every other column by its parent."""
        self.walk, seen = [(0, None, np.cumsum(self.ones[0] / self.ones[0].sum()))], {0}
        while len(seen) < len(self.columns):
            e = next((e for e in edges if (e[0] in seen) != (e[1] in seen)), None)
            if e is None:
                i = next(i for i in range(len(self.columns)) if i not in seen)
                self.walk.append((i, None, np.cumsum(self.ones[i] / self.ones[i].sum())))
                seen.add(i)
                continue
            a, b = e if e[0] in seen else e[::-1]
            m = pairs[e] if e[0] == a else pairs[e].T
            m = np.where(m.sum(1, keepdims=True) > 0, m, self.ones[b][None, :])
            self.walk.append((b, a, np.cumsum(m / m.sum(1, keepdims=True), axis=1)))
            seen.add(b)

    def apart(self, e: tuple[int, int], total: float) -> np.ndarray:
        """What a pair would be if its columns were independent."""
        return np.outer(self.ones[e[0]] / self.ones[e[0]].sum(), self.ones[e[1]] / self.ones[e[1]].sum()) * total

    def choose(self, true, rho, total, rng) -> list[tuple[int, int]]:
        d = len(self.columns)
        eps = math.sqrt(8 * rho / (d - 1))
        error = {e: float(np.abs(x - self.apart(e, total)).sum()) for e, x in true.items()}
        part, edges = list(range(d)), []
        while len(edges) < d - 1:
            free = [e for e in error if part[e[0]] != part[e[1]]]
            e = free[exponential_mechanism([error[x] for x in free], eps, 1.0, rng)]
            edges.append(e)
            old, new = part[e[1]], part[e[0]]
            part = [new if p == old else p for p in part]
        return edges

    def rows(self, n, rng):
        out = np.zeros((n, len(self.columns)), np.int64)
        for i, parent, cdf in self.walk:
            u = rng.random(n)
            out[:, i] = np.minimum(np.searchsorted(cdf, u), self.size[i] - 1) if parent is None else np.minimum((cdf[out[:, parent]] < u[:, None]).sum(1), self.size[i] - 1)
        for i, back in enumerate(self.back):
            first = np.array([v[0] for v in back])
            many = out[:, i] == len(back) - 1 if len(back[-1]) > 1 else np.zeros(n, bool)
            out[:, i] = first[out[:, i]]
            out[many, i] = rng.choice(back[-1], int(many.sum()))
        return out


class AIM(MST):
    """Adaptive and iterative choice over a workload of two-way marginals (arXiv 2201.12677), restricted to models that are trees. In each round
    the exponential mechanism picks the pair whose distance from the model exceeds what noise explains, weighted by the workload; the pair is
    measured, measurements of one pair are averaged by their precision, and the model is made anew. A round that moved the model by less than its
    noise doubles the next ones' budget. Pairs that would close a circle, or are larger than `max_cells`, aren't candidates."""

    def learn(self, df, epsilon):
        rho, rng, d = rho_of(epsilon, self.options.get("delta", 1e-9)), _rng(), len(self.columns)
        rounds = self.options.get("rounds") or 16 * d
        sigma, eps = math.sqrt(rounds / (1.8 * rho)), math.sqrt(0.8 * rho / rounds)
        if d == 1:
            sigma = math.sqrt(1 / (2 * rho))
        left = rho - d / (2 * sigma**2)
        self.compress([_gauss(x, sigma) for x in tables(df, self.columns, self.shape, [(i,) for i in range(d)])], sigma, -math.inf)
        weight = {e: 1.0 for e in combinations(range(d), 2)} | {tuple(sorted(self.columns.index(c) for c in w)): 2.0 for w in self.options.get("workload", [])}
        if any(len(e) != 2 for e in weight):
            raise ValueError("the workload must be pairs of columns")
        cells = self.options.get("max_cells", 10_000)
        wanted = [e for e in weight if self.shape[e[0]] * self.shape[e[1]] <= cells]
        if len(wanted) < len(weight):
            warnings.warn(f"{len(weight) - len(wanted)} pairs of more than {cells} cells can't be measured", stacklevel=2)
        true = dict(zip(wanted, tables(df, self.columns, self.shape, wanted), strict=True))
        part, edges, pairs, precision = list(range(d)), [], {}, {}
        self.measured = []
        while left > 1e-12 * rho:
            free = [e for e in true if e in pairs or part[e[0]] != part[e[1]]]
            if not free:
                break
            if left < 2 * (1 / (2 * sigma**2) + eps**2 / 8):  # the last round takes what is left
                sigma, eps = math.sqrt(1 / (1.8 * left)), math.sqrt(0.8 * left)
            left -= 1 / (2 * sigma**2) + eps**2 / 8
            total = max(1.0, float(np.mean([o.sum() for o in self.ones])))
            model = {e: pairs[e] if e in pairs else self.apart(e, total) for e in free}
            noise = math.sqrt(2 / math.pi) * sigma
            e = free[exponential_mechanism([weight[x] * (np.abs(true[x] - model[x]).sum() - noise * true[x].size) for x in free], eps, max(weight.values()), rng)]
            seen, w = _gauss(true[e], sigma), 1 / sigma**2
            self.measured.append((e, sigma))
            if e not in pairs:
                edges.append(e)
                old, new = part[e[1]], part[e[0]]
                part = [new if p == old else p for p in part]
            before = precision.get(e, 0.0)
            pairs[e] = (pairs[e] * before + seen * w) / (before + w) if before else seen
            precision[e] = before + w
            self.blend(e, seen, sigma)
            if np.abs(pairs[e] - model[e]).sum() <= noise * seen.size:
                sigma, eps = sigma / 2, eps * 2
        self.grow(edges, {e: _positive(x) for e, x in pairs.items()})


def _positive(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0)
    return x if x.sum() > 0 else np.ones_like(x)


class AggregateSeeded(Synthesizer):
    """Noisy counts of all combinations of up to `reporting_length` attributes, 3 by default; each length has an equal share of epsilon. Of single
    attributes every value is counted, of longer combinations those that occur, and a count is released above a threshold that a combination of
    one row passes with probability delta at most. Rows are grown attribute by attribute, each drawn by the counts of the longest combinations
    with what the row has, which back off to those of pairs and single attributes as far as noise outweighs them."""

    def learn(self, df, epsilon):
        d = len(self.columns)
        self.width = max(1, min(self.options.get("reporting_length", 3), d))
        delta = self.options.get("delta") or 1e-6
        each = epsilon / self.width
        self.singles = [_positive(_laplace(x, d / each)) for x in tables(df, self.columns, self.shape, [(i,) for i in range(d)])]
        self.longer, self.scale = {}, {}
        wanted = [some for w in range(2, self.width + 1) for some in combinations(range(d), w)]
        for some, (cell, n) in zip(wanted, occurring(df, self.columns, self.shape, wanted), strict=True):
            of = math.comb(d, len(some))
            scale = self.scale[len(some)] = of / each
            x = _laplace(n, scale)
            kept = x > 1 + scale * math.log(of * (self.width - 1) / (2 * delta))
            self.longer[some] = (cell[kept], x[kept])

    def aggregates(self) -> pd.DataFrame:
        """The released counts: attributes, values, count."""
        out = [(self.columns[i], str(v), float(n)) for i, s in enumerate(self.singles) for v, n in enumerate(s) if n > 0]
        for some, (cell, n) in self.longer.items():
            values = np.stack(np.unravel_index(cell, [self.shape[i] for i in some]), 1) if len(cell) else np.zeros((0, len(some)), np.int64)
            out += [(";".join(self.columns[i] for i in some), ";".join(map(str, v)), float(x)) for v, x in zip(values.tolist(), n.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["attributes", "values", "count"])

    def _counts(self, some: tuple[int, ...], rows: np.ndarray) -> np.ndarray:
        """Released counts of each row's values of some[:-1] with every value of some[-1]."""
        cell, n = self.longer[some]
        key = np.zeros(len(rows), np.int64)
        for i in some[:-1]:
            key = key * self.shape[i] + rows[:, i]
        key = key[:, None] * self.shape[some[-1]] + np.arange(self.shape[some[-1]])[None, :]
        if not len(cell):
            return np.zeros(key.shape)
        at = np.minimum(np.searchsorted(cell, key), len(cell) - 1)
        return np.where(cell[at] == key, n[at], 0.0)

    def rows(self, n, rng):
        out = np.zeros((n, len(self.columns)), np.int64)
        for i in range(len(self.columns)):
            p = np.tile(self.singles[i] / self.singles[i].sum(), (n, 1))
            if self.width > 1 and i:
                logs = np.log(p + 1e-12)
                for j in range(i):
                    x = self._counts((j, i), out) + self.scale[2] * p
                    logs += np.log(x / x.sum(1, keepdims=True) + 1e-12) - np.log(p + 1e-12)
                p = np.exp(logs - logs.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
            for w in range(3, min(self.width, i + 1) + 1):
                found = [self._counts((*some, i), out) + self.scale[w] * p for some in combinations(range(i), w - 1)]
                p = sum(x / x.sum(1, keepdims=True) for x in found) / len(found)
            out[:, i] = np.minimum((np.cumsum(p, axis=1) < rng.random(n)[:, None]).sum(1), self.shape[i] - 1)
        return out


class NaiveBayes:
    """A private classifier from noisy counts of (label, value)."""

    def fit(self, df: DataFrame, features: Sequence[str], shape: Sequence[int], target: str, classes: int, epsilon: float) -> NaiveBayes:
        each = epsilon / (len(features) + 1)
        self.prior = np.log(_positive(_laplace(table(df, [target], [classes]), 1 / each)) + 1)
        self.given = []
        for f, n in zip(features, shape, strict=True):
            m = np.maximum(_laplace(table(df, [target, f], [classes, n]), 1 / each), 0) + 1
            self.given.append(np.log(m / m.sum(1, keepdims=True)))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (self.prior[None, :] + sum(g[:, x[:, i]].T for i, g in enumerate(self.given))).argmax(1)


class QUAIL(Synthesizer):
    """A private classifier of the target takes eps_split of the budget, a synthesizer of the features the rest (arXiv 2011.05537)."""

    def learn(self, df, epsilon):
        split, target = self.options.get("eps_split", 0.9), self.options["target"]
        at = self.columns.index(target)
        self.at, rest = at, [i for i in range(len(self.columns)) if i != at]
        self.model = NaiveBayes().fit(df, [self.columns[i] for i in rest], [self.shape[i] for i in rest], target, self.shape[at], epsilon * split)
        inner = SYNTHESIZERS[self.options.get("synthesizer", "mst")](epsilon=epsilon * (1 - split))
        inner.columns, inner.shape = [self.columns[i] for i in rest], [self.shape[i] for i in rest]
        inner.learn(df.drop(target), epsilon * (1 - split))
        self.inner = inner

    def rows(self, n, rng):
        x = self.inner.rows(n, rng)
        return np.insert(x, self.at, self.model.predict(x), axis=1)


class _NeedsTorch(Synthesizer):
    """A registered name whose model is a neural network that needs torch."""

    def __init__(self, *a, **kw):
        raise NotImplementedError("this synthesizer needs torch, which isn't installed")


SYNTHESIZERS: dict[str, type[Synthesizer]] = {"mwem": MWEM, "mst": MST, "aim": AIM, "pacsynth": AggregateSeeded, "quail": QUAIL, "dpctgan": _NeedsTorch, "patectgan": _NeedsTorch, "dpgan": _NeedsTorch, "pategan": _NeedsTorch}


# ---- covariance and regression


def private_covariance(df: DataFrame, columns: Sequence[str], bounds: dict[str, tuple[float, float]], epsilon: float, noise: bool = True) -> np.ndarray:
    """The covariance matrix from clamped columns, Laplace noise on each entry of the lower triangle with sensitivity 2 range_i range_j / n."""
    cut = df.select(*[F.when(F.col(c) < lo, lo).when(F.col(c) > hi, hi).otherwise(F.col(c)).cast("double").alias(c) for c, (lo, hi) in bounds.items() if c in columns])
    r = covariance_sums(cut, columns).first()
    n = max(2, r["n"])
    out = np.zeros((len(columns), len(columns)))
    each = epsilon / (len(columns) * (len(columns) + 1) / 2)
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[: i + 1]):
            x = (r[f"p_{a}_{b}"] - r[f"s_{a}"] * r[f"s_{b}"] / n) / (n - 1)
            reach = 2 / n * (bounds[a][1] - bounds[a][0]) * (bounds[b][1] - bounds[b][0])
            out[i, j] = out[j, i] = Laplace(each, 0.0, reach).release([x])[0] if noise else x
    return out


class DPLinearRegression:
    """Least squares from the private covariance; the intercept comes from private means."""

    def __init__(self, fit_intercept: bool = False):
        self.fit_intercept = fit_intercept

    def fit(self, df: DataFrame, features: Sequence[str], target: str, bounds: dict[str, tuple[float, float]], budget: float, noise: bool = True) -> DPLinearRegression:
        columns = [*features, target]
        eps = budget * (0.9 if self.fit_intercept else 1)
        c = private_covariance(df, columns, bounds, eps, noise)
        k = len(features)
        self.coef_ = np.linalg.lstsq(c[:k, :k], c[:k, k], rcond=None)[0]
        self.intercept_ = 0.0
        if self.fit_intercept:
            row = df.agg(F.count(F.lit(1)), *[F.sum(F.when(F.col(x) < bounds[x][0], bounds[x][0]).when(F.col(x) > bounds[x][1], bounds[x][1]).otherwise(F.col(x)).cast("double")) for x in columns]).first()
            n = max(1, row[0])
            means = [Laplace(budget * 0.1 / len(columns), 0.0, (bounds[x][1] - bounds[x][0]) / n).release([row[1 + i] / n])[0] if noise else row[1 + i] / n for i, x in enumerate(columns)]
            self.intercept_ = float(means[-1] - np.dot(self.coef_, means[:-1]))
        return self

    def predict(self, df: DataFrame, features: Sequence[str], name: str = "prediction") -> DataFrame:
        x = F.lit(float(self.intercept_))
        for f, w in zip(features, self.coef_, strict=True):
            x = x + F.col(f) * float(w)
        return df.withColumn(name, x)


# ---- how useful synthetic data is


def pmse_ratio(original: DataFrame, synthetic: DataFrame, columns: Sequence[str], buckets: int = 20) -> float:
    """Mean squared propensity error over what chance gives. The propensity of a row is its cell's share of synthetic rows."""
    both = original.select(*columns, F.lit(0).alias("s_")).unionByName(synthetic.select(*columns, F.lit(1).alias("s_")))
    g = both.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.sum("s_").alias("s"))
    n, s, e, k = g.agg(F.sum("n"), F.sum("s"), F.sum(F.col("s") * F.col("s") / F.col("n")), F.count(F.lit(1))).first()
    c = s / n
    pmse = (e - 2 * c * s + c * c * n) / n
    return pmse / max(1e-12, (k - 1) * (1 - c) ** 2 * c / n)


def sra(real: Sequence[float], synthetic: Sequence[float]) -> float:
    """Synthetic ranking agreement: the share of pairs of models that both kinds of data rank alike."""
    k = len(real)
    agree = sum((real[i] - real[j]) * (synthetic[i] - synthetic[j]) > 0 for i in range(k) for j in range(k) if i != j)
    return agree / (k * (k - 1)) if k > 1 else 1.0


def wasserstein(original: DataFrame, synthetic: DataFrame, column: str, cells: int = 1000) -> float:
    """The distance of two one-dimensional distributions, from their quantiles."""
    at = [(i + 0.5) / cells for i in range(cells)]
    a, b = (np.array(df.agg(F.percentile_approx(column, at, 10_000)).first()[0], float) for df in (original, synthetic))
    return float(np.abs(a - b).mean())
