"""Index distributions: how a hash picks a register, as Column expressions.

Each has `index(u)` for a uniform in (0, 1), `probabilities()`, and `bounds()`, its
cumulative probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from tallyspark.functions.hashing import unit


class Distribution:
    length: int

    def index_of_hash(self, h: Column) -> Column:
        return self.index(unit(h))

    def index(self, u: Column) -> Column:
        raise NotImplementedError

    def probabilities(self) -> np.ndarray:
        raise NotImplementedError

    def bounds(self) -> np.ndarray:
        return np.cumsum(self.probabilities())


@dataclass(frozen=True)
class Uniform(Distribution):
    length: int

    def index_of_hash(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.length)).cast("int")

    def index(self, u: Column) -> Column:
        return F.least(F.floor(u * self.length), F.lit(self.length - 1)).cast("int")

    def probabilities(self) -> np.ndarray:
        return np.full(self.length, 1 / self.length)


class Decaying(Distribution):
    """Registers whose probabilities fall by a constant ratio: the index has a closed form."""

    def ratio(self) -> float:
        raise NotImplementedError

    def index(self, u: Column) -> Column:
        q = self.ratio()
        place = F.ceil(F.ln(1 - u * (1 - q**self.length)) / log(q)) - 1
        return F.least(F.greatest(place, F.lit(0)), F.lit(self.length - 1)).cast("int")

    def probabilities(self) -> np.ndarray:
        weights = self.ratio() ** np.arange(self.length)
        return weights / weights.sum()


@dataclass(frozen=True)
class Geometric(Decaying):
    length: int
    probability: float

    def ratio(self) -> float:
        return 1 - self.probability


@dataclass(frozen=True)
class Exponential(Decaying):
    length: int
    decay_rate: float

    def ratio(self) -> float:
        return exp(-self.decay_rate / (self.length + 1))


@dataclass(frozen=True)
class LogBucket(Distribution):
    """P(k) in proportion to -ln((k + 1) / (n + 1)). The inverse has no closed form: a vectorised
    binary search over the bounds, which are as long as the sketch."""

    length: int

    def index(self, u: Column) -> Column:
        bounds = self.bounds()
        last = self.length - 1

        @F.pandas_udf("int")
        def place(values: pd.Series) -> pd.Series:
            return pd.Series(np.minimum(np.searchsorted(bounds, values.to_numpy(), side="left"), last).astype(np.int32))

        return place(u)

    def probabilities(self) -> np.ndarray:
        k = np.arange(1, self.length + 1)
        weights = -np.log(k / (self.length + 1))
        return weights / weights.sum()


def known_probabilities(distribution: Distribution) -> np.ndarray:
    return distribution.probabilities()


def truncated_exponential_index(u: Column, a: float, m: int) -> Column:
    """The register of a continuous truncated exponential variable times m."""
    return F.least(F.floor(m * (1 - F.ln(exp(a) + u * (1 - exp(a))) / a)), F.lit(m - 1)).cast("int")


def cascading_index(f: Column, legions: int, positions: int) -> Column:
    """The legion is the number of trailing zeros, at most the last; the other bits pick the position."""
    zeros = F.when(f == 0, F.lit(64)).otherwise(F.bit_count(f.bitwiseAND(-f) - 1))
    place = F.shiftrightunsigned(f, 1)
    # shift by the zeros as well, by a division, as shifts take no columns
    rest = F.floor(place / F.pow(F.lit(2.0), F.least(zeros, F.lit(40)))).cast("long")
    return (F.least(zeros, F.lit(legions - 1)) * positions + F.pmod(rest, F.lit(positions))).cast("int")


def leading_zero_rank(h: Column, index_bits: int, hash_bits: int) -> tuple[Column, Column]:
    """(register, rank): the top index_bits of a hash, and one plus the leading zeros of the others."""
    rest = hash_bits - index_bits
    w = h.bitwiseAND(F.lit((1 << rest) - 1))
    rank = F.when(w == 0, rest + 1).otherwise(rest + 1 - F.length(F.bin(w)))
    return F.shiftright(h, rest).cast("int"), rank.cast("int")
