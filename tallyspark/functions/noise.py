"""Noise as Column expressions of hash-uniforms, and its inverse on registers.

For studying accuracy; hash-based noise gives no privacy to real users.
"""

from __future__ import annotations

from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from tallyspark.functions.hashing import h60_value, uniform
from tallyspark.functions.numerics import gaussian_sigma

Part = Column | str | int | float


def laplace(scale: float, *parts: Part) -> Column:
    """Laplace noise of this scale at these coordinates."""
    u = uniform("laplace", *parts) - 0.5
    return -scale * F.signum(u) * F.ln(1 - 2 * F.abs(u))


def geometric(epsilon: float, *parts: Part, sensitivity: float = 1.0) -> Column:
    """Two-sided geometric noise: the difference of two geometric numbers."""
    fall = -epsilon / sensitivity
    one, two = (F.ceil(F.ln(uniform(f"geometric{i}", *parts)) / fall) for i in (1, 2))
    return (one - two).cast("long")


def gaussian(epsilon: float, delta: float, *parts: Part, sensitivity: float = 1.0, num_queries: int = 1) -> Column:
    """Gaussian noise by Box and Muller, with the least sigma for the budget over num_queries."""
    sigma = gaussian_sigma(epsilon, delta, sensitivity, num_queries)
    return sigma * F.sqrt(-2 * F.ln(uniform("gauss1", *parts))) * F.cos(2 * np.pi * uniform("gauss2", *parts))


def discrete_gaussian(sigma: float, seed: Column) -> Column:
    """Discrete Gaussian noise by rejection from discrete Laplace noise (Canonne, Kamath and Steinke
    2020); seed is a bigint that names the row, and the only source of randomness."""
    t = int(np.floor(sigma)) + 1

    @F.pandas_udf("long")
    def draw(seeds: pd.Series) -> pd.Series:
        out = np.empty(len(seeds), dtype=np.int64)
        for i, s in enumerate(seeds):
            rng = np.random.default_rng(int(s) & (1 << 62) - 1)
            while True:
                y = int(rng.geometric(1 - exp(-1 / t)) - rng.geometric(1 - exp(-1 / t)))
                if rng.random() <= exp(-((abs(y) - sigma**2 / t) ** 2) / (2 * sigma**2)):
                    out[i] = y
                    break
        return pd.Series(out)

    return draw(seed)


def flip_bit(bit: Column, rise: float, fall: float, *parts: Part) -> Column:
    """A 0/1 register after random response: 0 to 1 with chance rise, 1 to 0 with chance fall."""
    u = uniform("flip", *parts)
    return F.when(bit > 0, (u >= fall).cast("int")).otherwise((u < rise).cast("int"))


def unflip(value: Column, probability: float) -> Column:
    """The register whose expectation after flips is value; may leave [0, 1]."""
    if probability == 0.5:
        raise ValueError("flips of chance 1/2 keep nothing")
    return (value - probability) / (1 - 2 * probability)


#: Names of estimate noisers, with the arguments each takes.
ESTIMATE_NOISERS = {"laplace": ("epsilon",), "geometric": ("epsilon",), "gaussian": ("epsilon", "delta", "num_queries"), "discrete_gaussian": ("epsilon", "delta", "num_queries")}


def noised_estimate(value: Column, kind: str | None, *parts: Part, epsilon: float | None = None, delta: float | None = None, num_queries: int = 1) -> Column:
    """An estimate of sensitivity 1 with global noise; the budget is split over num_queries."""
    if kind is None or epsilon is None:
        return value
    if kind not in ESTIMATE_NOISERS:
        raise ValueError(f"noise is one of {sorted(ESTIMATE_NOISERS)}, not {kind!r}")
    if kind == "laplace":
        return value + laplace(num_queries / epsilon, *parts)
    if kind == "geometric":
        return value + geometric(epsilon / num_queries, *parts)
    if delta is None:
        raise ValueError(f"{kind} noise needs delta")
    if kind == "gaussian":
        return value + gaussian(epsilon, delta, *parts, num_queries=num_queries)
    from tallyspark.functions.hashing import h60

    return value + discrete_gaussian(gaussian_sigma(epsilon, delta, 1.0, num_queries), h60("discrete", *parts))


def noise_values(kind: str, size: int, *parts: object, epsilon: float, delta: float | None = None, num_queries: int = 1) -> np.ndarray:
    """The same kinds of noise in numpy, for estimators that work on whole vectors."""
    rng = np.random.default_rng(h60_value("noise", kind, *parts))
    if kind == "laplace":
        return rng.laplace(0, num_queries / epsilon, size)
    if kind == "geometric":
        p = 1 - exp(-epsilon / num_queries)
        return (rng.geometric(p, size) - rng.geometric(p, size)).astype(np.float64)
    if delta is None:
        raise ValueError(f"{kind} noise needs delta")
    noise = rng.normal(0, gaussian_sigma(epsilon, delta, 1.0, num_queries), size)
    return np.rint(noise) if kind == "discrete_gaussian" else noise
