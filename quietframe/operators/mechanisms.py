"""Noise: Laplace, geometric and Gaussian mechanisms, thresholds for rare groups, and accuracy.

Integers get discrete Laplace noise (the difference of two geometric numbers). Floats are rounded to a grid of a power of two about scale / 1024
wide, the grid's step is added to the sensitivity for the rounding, and the noise is discrete Laplace on the grid; that keeps the low
bits of doubles from telling the exact value. Randomness is the operating system's.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

LARGEST = 1e7


def delta_of(rho: float, epsilon: float) -> float:
    """The least delta at which rho-zCDP gives (epsilon, delta), minimised over the order (arXiv 2004.00010)."""

    def at(alpha: float) -> float:
        return (alpha - 1) * (alpha * rho - epsilon) + alpha * math.log1p(-1 / alpha) - math.log(alpha - 1)

    lo, hi = 1 + 1e-9, max(2.0, (epsilon + 1) / (2 * rho) + 2) if rho > 0 else 2.0
    if rho <= 0:
        return 0.0
    while at(hi * 2) < at(hi) and hi < 1e12:
        hi *= 2
    hi *= 2
    for _ in range(200):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if at(a) < at(b) else (a, hi)
    return min(1.0, math.exp(min(0.0, at((lo + hi) / 2))))


@lru_cache(maxsize=1024)
def rho_of(epsilon: float, delta: float) -> float:
    """The largest rho whose zCDP gives (epsilon, delta)."""
    if not 0 < delta < 1:
        raise ValueError("delta must be between 0 and 1")
    lo, hi = 0.0, epsilon + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if delta_of(mid, epsilon) <= delta else (lo, mid)
    return lo


@dataclass(frozen=True)
class Mechanism:
    """Common part: epsilon, delta, what one row changes, and how many rows one individual has."""

    epsilon: float
    delta: float = 0.0
    sensitivity: float = 1.0
    max_contrib: int = 1

    def __post_init__(self) -> None:
        if not self.epsilon > 0:
            raise ValueError("epsilon must be positive")
        if self.sensitivity is None or math.isinf(self.sensitivity):
            raise ValueError("attempting to query an unbounded column")
        if self.sensitivity * self.max_contrib / self.epsilon > LARGEST:
            raise ValueError(f"sensitivity {self.sensitivity} times {self.max_contrib} over epsilon {self.epsilon} is too large")

    @property
    def reach(self) -> float:
        return self.sensitivity * self.max_contrib


class Laplace(Mechanism):
    @property
    def scale(self) -> float:
        return self.reach / self.epsilon

    @property
    def threshold(self) -> float:
        """The noisy key count over which a group may show."""
        if not self.delta > 0:
            raise ValueError("a threshold needs delta")
        m = self.max_contrib
        return m * (1 - math.log(2 * self.delta / m) / self.epsilon)

    def accuracy(self, alpha: float) -> float:
        return self.scale * math.log(1 / alpha)

    def draw(self, value: float, whole: bool, source: random.Random) -> float:
        return _noisy(value, whole, self.reach, self.epsilon, source)

    def release(self, values, whole: bool = False) -> list:
        source = random.SystemRandom()
        return [self.draw(v, whole, source) for v in values]


class Geometric(Laplace):
    """Laplace noise on integers is the geometric mechanism already."""


class Gaussian(Mechanism):
    @property
    def scale(self) -> float:
        if not self.delta > 0:
            raise ValueError("the Gaussian mechanism needs delta")
        return self.reach / math.sqrt(2 * rho_of(self.epsilon, self.delta))

    @property
    def threshold(self) -> float:
        return 1 + self.scale * NormalDist().inv_cdf((1 - self.delta / 2) ** (1 / self.max_contrib))

    def accuracy(self, alpha: float) -> float:
        return self.scale * NormalDist().inv_cdf(1 - alpha / 2)

    def draw(self, value: float, whole: bool, source: random.Random) -> float:
        grid = 2.0 ** math.floor(math.log2(self.scale / 1024)) if not whole else 1.0
        noise = source.gauss(0, self.scale)
        x = round(value / grid) * grid + round(noise / grid) * grid
        return int(x) if whole else x

    def release(self, values, whole: bool = False) -> list:
        source = random.SystemRandom()
        return [self.draw(v, whole, source) for v in values]


def _geometric(p: float, source: random.Random) -> int:
    """Failures before the first success, where each fails with probability p."""
    if p <= 0:
        return 0
    return int(math.floor(math.log(1.0 - source.random()) / math.log(p)))


def discrete_laplace(scale: float, source: random.Random) -> int:
    p = math.exp(-1 / scale)
    return _geometric(p, source) - _geometric(p, source)


def _noisy(value: float, whole: bool, reach: float, epsilon: float, source: random.Random) -> float:
    if whole:
        return int(value) + discrete_laplace(max(reach, 1e-9) / epsilon, source)
    grid = 2.0 ** math.floor(math.log2(max(reach, 1e-9) / epsilon / 1024))
    return (round(value / grid) + discrete_laplace((reach + grid) / epsilon / grid, source)) * grid


MECHANISMS: dict[str, type[Mechanism]] = {"laplace": Laplace, "geometric": Geometric, "discrete_laplace": Geometric, "gaussian": Gaussian, "discrete_gaussian": Gaussian}
#: The mechanism of each kind of statistic; "large" kinds are for sensitivities over 1,000.
DEFAULTS = {"count": "laplace", "sum_int": "laplace", "sum_large_int": "laplace", "sum_float": "laplace", "sum_large_float": "laplace", "threshold": "laplace"}


@dataclass
class Privacy:
    """The budget of one statistic of one query, and the mechanisms of kinds of statistics."""

    epsilon: float = 1.0
    delta: float = 1e-15
    alphas: tuple[float, ...] = ()
    mechanisms: dict[str, str] | None = None

    def __post_init__(self) -> None:
        if not self.epsilon > 0 or not 0 <= self.delta < 1:
            raise ValueError("epsilon must be positive and delta from 0 to 1")
        self.mechanisms = DEFAULTS | (self.mechanisms or {})

    def mechanism(self, kind: str, sensitivity: float | None, max_contrib: int) -> Mechanism:
        if sensitivity is None:
            raise ValueError("attempting to query an unbounded column")
        if kind.startswith("sum_") and sensitivity > 1000:
            kind = kind.replace("sum_", "sum_large_")
        cls = MECHANISMS[self.mechanisms[kind]]
        delta = self.delta if kind == "threshold" or issubclass(cls, Gaussian) else 0.0
        return cls(self.epsilon, delta, float(sensitivity), max_contrib)


# ---- composition


class Odometer:
    """k releases at the same (epsilon, delta): the tightest of the three bounds of the homogeneous composition theorem (arXiv 1311.0776)."""

    def __init__(self, privacy: Privacy, tolerance: float | None = None):
        self.privacy, self.k = privacy, 0
        self.tolerance = privacy.delta / 2 if tolerance is None else tolerance

    def spend(self, k: int = 1) -> None:
        self.k += k

    def reset(self) -> None:
        self.k = 0

    @property
    def spent(self) -> tuple[float, float]:
        if not self.k:
            return 0.0, 0.0
        return compose([(self.privacy.epsilon, self.privacy.delta)] * self.k, self.tolerance)


def compose(steps: list[tuple[float, float]], tolerance: float) -> tuple[float, float]:
    """epsilon is the least of the plain sum and two bounds that hold but for `tolerance`; delta multiplies up."""
    total = sum(e for e, _ in steps)
    none = math.prod(1 - d for _, d in steps)
    if tolerance <= 0:
        return total, 1 - none
    squares = sum(e * e for e, _ in steps)
    drift = sum((math.exp(e) - 1) * e / (math.exp(e) + 1) for e, _ in steps)
    a = drift + math.sqrt(2 * squares * math.log(math.e + math.sqrt(squares) / tolerance))
    b = drift + math.sqrt(2 * squares * math.log(1 / tolerance))
    return (total, 1 - none) if total <= min(a, b) else (min(a, b), 1 - (1 - tolerance) * none)


class OdometerHeterogeneous:
    """Releases at any (epsilon, delta), with an optional cap that is checked before a release."""

    def __init__(self, privacy: Privacy | None = None, tolerance: float | None = None, cap: float | None = None):
        self.tolerance = tolerance if tolerance is not None else (privacy.delta / 2 if privacy else 0.0)
        self.steps: list[tuple[float, float]] = []
        self.cap = cap

    @property
    def k(self) -> int:
        return len(self.steps)

    def check(self, steps: list[tuple[float, float]]) -> None:
        if self.cap is not None and compose([*self.steps, *steps], self.tolerance)[0] > self.cap:
            raise ValueError(f"the release would go over the budget of {self.cap}")

    def spend(self, privacy: Privacy | tuple[float, float]) -> None:
        step = (privacy.epsilon, privacy.delta) if isinstance(privacy, Privacy) else privacy
        self.check([step])
        self.steps.append(step)

    def reset(self) -> None:
        self.steps = []

    @property
    def spent(self) -> tuple[float, float]:
        return compose(self.steps, self.tolerance) if self.steps else (0.0, 0.0)
