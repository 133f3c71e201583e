"""Numerical routines that SQL lacks, vectorised over numpy arrays."""

from __future__ import annotations

from collections.abc import Callable
from math import comb, erf, exp, lgamma, log, sqrt

import numpy as np

EULER = 0.57721566490153286061


def invert_monotonic(f: Callable[[np.ndarray], np.ndarray], y: np.ndarray, lower: float = 0.0, epsilon: float = 1e-3, most: float = 1e15) -> np.ndarray:
    """For each y the x >= lower with f(x) = y, f increasing: bracket by doubling, then bisect.

    A y that f does not reach below `most` gives infinity; NaN gives NaN.
    """
    y = np.atleast_1d(np.asarray(y, dtype=np.float64))
    low, high = np.full(y.shape, float(lower)), np.full(y.shape, max(1.0, 2.0 * lower))
    with np.errstate(all="ignore"):
        while True:
            short = (f(high) < y) & (high < most)
            if not short.any():
                break
            low = np.where(short, high, low)
            high = np.where(short, high * 2, high)
        never = f(high) < y
        while ((high - low) > epsilon).any():
            middle = (low + high) / 2
            if ((middle == low) | (middle == high)).all():
                break
            below = f(middle) < y
            low, high = np.where(below, middle, low), np.where(below, high, middle)
    out = (low + high) / 2
    return np.where(np.isnan(y), np.nan, np.where(never, np.inf, out))


def exponential_integral(x: np.ndarray) -> np.ndarray:
    """E1(x) for x > 0: power series up to 1, continued fraction beyond."""
    x = np.asarray(x, dtype=np.float64)
    small = np.minimum(x, 1.0)
    total, term = np.zeros_like(x), np.ones_like(x)
    for k in range(1, 30):
        term = term * -small / k
        total -= term / k
    with np.errstate(all="ignore"):
        series = -EULER - np.log(small) + total
        big = np.maximum(x, 1.0)
        # modified Lentz
        b = big + 1
        c, d = np.full_like(x, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 200):
            a = -i * i
            b = b + 2
            d = 1 / (a * d + b)
            c = b + a / c
            h *= c * d
        fraction = h * np.exp(-big)
    return np.where(x <= 1, series, fraction)


def exponential_fill(reach: np.ndarray, decay: float) -> np.ndarray:
    """Expected share of active registers of an exponential filter, at cardinality / length."""
    r = np.maximum(np.asarray(reach, dtype=np.float64), 1e-300)
    low = decay * r / (exp(decay) - 1)
    return 1 - (exponential_integral(low) - exponential_integral(low * exp(decay))) / decay


def invert_exponential(active: np.ndarray, length: int, decay: float) -> np.ndarray:
    """Cardinality of an exponential filter with so many active registers."""
    share = np.clip(np.asarray(active, dtype=np.float64) / length, 0, 1)
    out = invert_monotonic(lambda r: exponential_fill(r, decay), np.minimum(share, 1 - 1e-16), 0.0, 1e-12, 1e12) * length
    return np.where(share <= 0, 0.0, out)


def invert_fill(active: np.ndarray, probabilities: np.ndarray, epsilon: float = 1e-6) -> np.ndarray:
    """The n with sum(1 - (1 - p)^n) = active; up to one active register gives 0, as does
    a target below what one id already makes."""
    x = np.atleast_1d(np.asarray(active, dtype=np.float64))
    stay = np.log1p(-np.minimum(probabilities, 1 - 1e-15))

    def filled(n: np.ndarray) -> np.ndarray:
        return np.array([np.sum(-np.expm1(v * stay)) for v in np.atleast_1d(n)])

    return invert_monotonic(filled, x, 0.0, epsilon)


def invert_halving(f: Callable[[float], float], y: np.ndarray, most: float = 1e12, steps: int = 110) -> np.ndarray:
    """For each y the n from 0 on where an increasing f reaches it, by so many halvings of 0 to most, or of more where
    that doesn't reach it; infinity where nothing does, 0 for no y above 0.

    Where f ends in steps of its last digits the halvings' path picks one, so it is the path of the queries' SQL.
    """
    out = np.zeros(len(y))
    for i, target in enumerate(y):
        if not target > 0:
            continue
        low, high = 0.0, most
        while f(high) < target and high < 1e30:
            high *= 2
        if f(high) < target:
            out[i] = np.inf
            continue
        for _ in range(steps):
            middle = (low + high) / 2
            low, high = (middle, high) if f(middle) < target else (low, middle)
        out[i] = (low + high) / 2
    return out


def ordered_fill(n: float, probabilities: np.ndarray, weights: np.ndarray | None = None) -> float:
    """sum(w (1 - (1 - p)^n)), added up in the registers' order."""
    chances = 1 - (1 - probabilities) ** n
    return float(np.cumsum(chances if weights is None else weights * chances)[-1])


def saturation(probabilities: np.ndarray) -> float:
    """The n from which a filter's expected registers are all active in double precision."""
    return float(invert_halving(lambda n: ordered_fill(n, probabilities), np.array([float(len(probabilities))]))[0])


def invert_weighted(bits: np.ndarray, probabilities: np.ndarray, weights: np.ndarray | None = None, epsilon: float = 1e-6) -> float:
    """The n at which the weighted expected registers equal the weighted observed ones."""
    w = np.ones_like(probabilities) if weights is None else np.asarray(weights, dtype=np.float64)
    stay = np.log1p(-np.minimum(probabilities, 1 - 1e-15))
    target = float(np.sum(w * bits))
    return float(invert_monotonic(lambda n: np.array([np.sum(w * -np.expm1(v * stay)) for v in np.atleast_1d(n)]), target, 0.0, epsilon)[0])


def cascading_fill(cardinality: np.ndarray, legions: int, positions: int) -> np.ndarray:
    """Expected active positions over all cascading legions; the last one takes twice its share."""
    scale = 2.0 ** np.append(np.arange(1, legions), legions - 1)
    c = np.atleast_1d(np.asarray(cardinality, dtype=np.float64))
    return (positions * -np.expm1(-c[:, None] / (scale * positions))).sum(axis=1)


def transitions(sketches: int, flip: float) -> np.ndarray:
    """[t, s]: the chance that a position with s ones among the sketches shows t ones after flips."""
    out = np.zeros((sketches + 1, sketches + 1))
    for s in range(sketches + 1):
        for stay in range(s + 1):
            for rise in range(sketches - s + 1):
                chance = comb(s, stay) * (1 - flip) ** stay * flip ** (s - stay) * comb(sketches - s, rise) * flip**rise * (1 - flip) ** (sketches - s - rise)
                out[stay + rise, s] += chance
    return out


def combination_transitions(flips: list[float]) -> np.ndarray:
    """[t, s]: the chance that the bit pattern s over the sketches shows as t; bit j is sketch j."""
    out = np.ones((1, 1))
    for p in flips:
        out = np.kron(np.array([[1 - p, p], [p, 1 - p]]), out)
    return out


def flip_probability(epsilon: float, num_hashes: int = 1) -> float:
    """The chance of a bit's flip that gives epsilon-local privacy over num_hashes bits."""
    return 1 / (1 + exp(epsilon / num_hashes))


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + erf(x / sqrt(2)))


def gaussian_sigma(epsilon: float, delta: float, sensitivity: float = 1.0, num_queries: int = 1) -> float:
    """The least sigma for which Gaussian noise on num_queries queries is (epsilon, delta)-private.

    Bisects the exact condition of Balle and Wang (2018); composing q queries is
    one query of sensitivity times sqrt(q).
    """
    size = sensitivity * sqrt(num_queries)

    def spent(sigma: float) -> float:
        a, b = size / (2 * sigma), epsilon * sigma / size
        return normal_cdf(a - b) - exp(min(epsilon, 700.0)) * normal_cdf(-a - b)

    low, high = 0.0, size
    while spent(high) > delta:
        low, high = high, high * 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if spent(middle) > delta else (low, middle)
    return high


def truncated_poisson(rate: float, cap: int) -> np.ndarray:
    """P(frequency = 1 .. cap) of one plus a Poisson number, all beyond cap put at cap."""
    if rate <= 0 or cap < 1:
        raise ValueError(f"rate and cap are positive, not {rate}, {cap}")
    head = np.array([exp(k * log(rate) - rate - lgamma(k + 1)) for k in range(cap - 1)])
    return np.append(head, max(0.0, 1 - head.sum()))


def reverse_cumulative(h: np.ndarray) -> np.ndarray:
    return np.cumsum(np.asarray(h)[::-1])[::-1]
