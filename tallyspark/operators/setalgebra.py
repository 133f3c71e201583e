"""Union, intersection and difference of sketches.

Each operator is given twice where both shapes are needed: on register tables, as joins and
aggregates, and on numpy vectors, for the ordered folds that see one run at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions.distributions import Distribution, known_probabilities
from tallyspark.operators.estimators import first_moment_value

# ---- exact sets ----------------------------------------------------------------------------


def set_union(one: DataFrame | None, two: DataFrame | None) -> DataFrame | None:
    """Distinct ids of either; an absent set counts as empty."""
    if one is None or two is None:
        found = one if two is None else two
        return None if found is None else found.select("id").distinct()
    return one.select("id").unionAll(two.select("id")).distinct()


def set_intersection(one: DataFrame | None, two: DataFrame | None) -> DataFrame | None:
    return None if one is None or two is None else one.select("id").intersect(two.select("id"))


def set_difference(one: DataFrame | None, two: DataFrame | None) -> DataFrame | None:
    if one is None:
        return None
    return one.select("id").distinct() if two is None else one.select("id").subtract(two.select("id"))


# ---- filters -------------------------------------------------------------------------------


def fuzzy_union(one: DataFrame, two: DataFrame) -> DataFrame:
    """Registers 1 - (1 - a)(1 - b), for bits and for denoised values."""
    both = one.select("register", F.col("value").cast("double").alias("a")).join(two.select("register", F.col("value").cast("double").alias("b")), "register", "full")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return both.select("register", (1 - (1 - a) * (1 - b)).alias("value"))


@dataclass(frozen=True)
class FilterAlgebra:
    """Approximate set algebra on filters of one distribution, as vectors.

    kind 'bayesian' weighs a register that is set in both by the posterior that a shared id set it;
    'expectation' thins the registers to the expected number.
    """

    distribution: Distribution
    kind: str = "expectation"
    threshold: float = 1e-6

    def __post_init__(self) -> None:
        if self.kind not in ("expectation", "bayesian"):
            raise ValueError(f"kind is expectation or bayesian, not {self.kind!r}")

    def size(self, v: np.ndarray) -> float:
        return first_moment_value(float(v.sum()), self.distribution)

    def union(self, a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
        if a is None or b is None:
            return b if a is None else a
        return 1 - (1 - a) * (1 - b)

    def venn(self, a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
        """Cardinalities of both and of their intersection, at least 0."""
        x, y = self.size(a), self.size(b)
        return x, y, max(x + y - self.size(self.union(a, b)), 0.0)

    def hit(self, cardinality: float, probabilities: np.ndarray | None = None) -> np.ndarray:
        p = known_probabilities(self.distribution) if probabilities is None else probabilities
        # an estimate from noised registers may be undefined: then nobody is behind it; negative ones count
        with np.errstate(all="ignore"):
            return 1 - np.power(1 - p, cardinality if np.isfinite(cardinality) else 0.0)

    def overlaps(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, common = self.venn(a, b)
        return self.hit(common), self.hit(x - common), self.hit(y - common)

    def thinned(self, weights: np.ndarray, expected: float) -> np.ndarray:
        p = known_probabilities(self.distribution)
        total = max(float(np.sum(p * weights)), self.threshold, float(p.min()))
        return self.hit(expected, np.minimum(1, p / total))

    def intersection(self, a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
        if a is None or b is None:
            return None
        if self.kind == "bayesian":
            shared, mine, theirs = self.overlaps(a, b)
            return a * b * shared / np.maximum(self.threshold, mine * theirs * (1 - shared) + shared)
        return a * b * self.thinned(a * b, self.venn(a, b)[2])

    def difference(self, a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
        if a is None or b is None:
            return a
        if self.kind == "bayesian":
            shared, mine, theirs = self.overlaps(a, b)
            possible = np.maximum(self.threshold, mine * theirs * (1 - shared) + shared)
            # of the ways in which both registers are set, those in which an own id is behind a's
            still = mine * theirs * shared + mine * (1 - theirs) * shared + mine * theirs * (1 - shared)
            return a * (1 - b) + a * b * still / possible
        x, _, common = self.venn(a, b)
        hidden = max(0.0, min(x - common, x - common - float(a @ (1 - b))))
        return a * (1 - b) + a * b * self.thinned(a, hidden)


# ---- vectors of counts ---------------------------------------------------------------------


@dataclass(frozen=True)
class CountAlgebra:
    """Pairwise algebra on vectors of counts."""

    clip: bool = False
    epsilon: float = float("inf")
    clip_threshold: float = 3.0

    def intersection_size(self, a: np.ndarray, b: np.ndarray) -> float:
        """Hashing spreads each set's ids evenly, so what the buckets share is their covariance."""
        return float((a - a.mean()) @ (b - b.mean()))

    def union_size(self, a: np.ndarray, b: np.ndarray) -> float:
        return float(a.sum() + b.sum()) - self.intersection_size(a, b)

    def deviation(self, common: float, a: np.ndarray, b: np.ndarray) -> float:
        n, e = len(a), self.epsilon
        return sqrt((a.sum() * b.sum() + common * common) / n + 4 * n / e**4 + 2 * (a.sum() + b.sum()) / e**2)

    def score(self, estimate: float, value: float, a: np.ndarray, b: np.ndarray) -> float:
        """How many deviations an intersection estimate is above a value."""
        return (estimate - value) / self.deviation(value, a, b)

    def has_none(self, estimate: float, a: np.ndarray, b: np.ndarray) -> bool:
        return self.score(estimate, 0.0, a, b) < self.clip_threshold

    def has_all(self, estimate: float, a: np.ndarray, b: np.ndarray) -> bool:
        return self.score(estimate, float(min(a.sum(), b.sum())), a, b) > -self.clip_threshold

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a + b less the intersection, taken from each bucket in proportion to what it holds."""
        common, total = self.intersection_size(a, b), float(a.sum() + b.sum())
        if self.clip:
            if self.has_none(common, a, b):
                return a + b
            if self.has_all(common, a, b):
                return a.copy()
        if total == 0:
            return a + b - common / len(a)
        return (a + b) * (1 - common / total)

    def clipped_empty(self, a: np.ndarray) -> np.ndarray:
        """A vector whose sum is within noise of 0 becomes 0."""
        return np.zeros_like(a) if a.sum() / (sqrt(2 * len(a)) / self.epsilon) < self.clip_threshold else a

    def prefix_sizes(self, sketches: list[np.ndarray]) -> list[float]:
        """Union sizes of the first 1 .. n vectors, merged left to right."""
        own = [self.clipped_empty(s) for s in sketches] if self.clip else sketches
        out, state = [], None
        for s in own:
            state = s if state is None else self.merge(state, s)
            out.append(float(state.sum()))
        return out


@dataclass(frozen=True)
class StratifiedCountAlgebra:
    """The algebra that stratified merging needs: unions there are of disjoint sets, and what is
    taken away is a subset."""

    clip: bool = False
    epsilon: float = float("inf")
    clip_threshold: float = 3.0

    def union(self, a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
        if a is None or b is None:
            return b if a is None else a
        return a + b

    def intersection(self, a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
        if a is None or b is None:
            return None
        return a + b - CountAlgebra(self.clip, self.epsilon, self.clip_threshold).merge(a, b)

    def difference(self, a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
        return a if a is None or b is None else a - b

    def size(self, a: np.ndarray) -> float:
        return float(a.sum())


@dataclass(frozen=True)
class ExactAlgebra:
    """The same algebra on exact sets of ids."""

    def union(self, a: frozenset | None, b: frozenset | None) -> frozenset | None:
        return (b if a is None else a) if a is None or b is None else a | b

    def intersection(self, a: frozenset | None, b: frozenset | None) -> frozenset | None:
        return None if a is None or b is None else a & b

    def difference(self, a: frozenset | None, b: frozenset | None) -> frozenset | None:
        return a if a is None or b is None else a - b

    def size(self, a: frozenset) -> float:
        return float(len(a))


# ---- vectors of counts as columns ----------------------------------------------------------


def count_intersection(a: Column, b: Column) -> Column:
    """Covariance of two dense arrays of bucket counts."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dot - total(a) * total(b) / F.size(a)


def pairwise_counts(stats: DataFrame) -> DataFrame:
    """(run_index, set_index, next_index, intersection, union_size) of each set with each later one."""
    a = stats.select("run_index", "set_index", F.col("stats").alias("a"))
    b = stats.select("run_index", F.col("set_index").alias("next_index"), F.col("stats").alias("b"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    both = a.join(b, "run_index").where("set_index < next_index")
    common = count_intersection(F.col("a"), F.col("b"))
    return both.select("run_index", "set_index", "next_index", common.alias("intersection"), (total(F.col("a")) + total(F.col("b")) - common).alias("union_size"))
