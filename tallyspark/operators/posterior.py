"""Posterior sampling of clean legion registers from noised ones, and the merge built on it.

For one or two sketches the Venn diagram's cardinalities give each register's prior over bit
patterns, the flips give the likelihood of what is seen, and a hash-uniform picks from the posterior.
"""

from __future__ import annotations

from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyspark.functions.hashing import h60_value
from tallyspark.functions.numerics import combination_transitions, invert_exponential
from tallyspark.operators.estimators import venn_cardinalities
from tallyspark.operators.folds import vectors, with_empty_sets
from tallyspark.operators.sketches import LiquidLegions


def hit_probabilities(sketch: LiquidLegions, cardinality: float) -> np.ndarray:
    """Of every register, the chance that one of so many ids is in it."""
    a, m = sketch.decay_rate, sketch.length
    density = a * np.exp(a * (1 - np.arange(m) / m)) / (exp(a) - 1)
    return -np.expm1(-density / m * cardinality)


def observed(bits: list[np.ndarray]) -> np.ndarray:
    """Bit pattern of each register; bit j is sketch j."""
    return sum((b > 0).astype(np.int64) << j for j, b in enumerate(bits))


def priors(sketch: LiquidLegions, venn: np.ndarray) -> np.ndarray:
    """[register, pattern] from the cardinalities of the Venn diagram's parts."""
    hit = [hit_probabilities(sketch, c) for c in venn]
    if len(venn) == 2:
        return np.stack([1 - hit[1], hit[1]], axis=1)
    a, b, both = hit[1], hit[2], hit[3]
    return np.stack([(1 - a) * (1 - b) * (1 - both), a * (1 - b) * (1 - both), (1 - a) * b * (1 - both), a * b * (1 - both) + both], axis=1)


def venn_of(bits: list[np.ndarray], flips: list[float], sketch: LiquidLegions) -> np.ndarray:
    return venn_cardinalities(np.bincount(observed(bits), minlength=1 << len(bits)), flips, sketch)


def sample(bits: list[np.ndarray], flips: list[float], sketch: LiquidLegions, rng: np.random.Generator) -> list[np.ndarray]:
    """Clean registers of one or two sketches, drawn from the posterior."""
    weight = priors(sketch, venn_of(bits, flips, sketch)) * combination_transitions(flips)[observed(bits)]
    total = weight.sum(axis=1, keepdims=True)
    weight = np.where(total > 0, weight / np.where(total > 0, total, 1), 1 / weight.shape[1])
    pattern = (np.cumsum(weight, axis=1) < rng.random((len(weight), 1))).sum(axis=1).clip(0, weight.shape[1] - 1)
    return [(pattern >> j & 1).astype(np.float64) for j in range(len(bits))]


def difference_probabilities(bits: list[np.ndarray], sketch: LiquidLegions) -> np.ndarray:
    """Of clean sketches A and B, the chance that each register is set in a sketch of A - B."""
    hit = [hit_probabilities(sketch, c) for c in venn_of(bits, [0.0, 0.0], sketch)]
    a, b, both = hit[1], hit[2], hit[3]
    own = a * b * both + a * (1 - b) * both + a * b * (1 - both)
    all_ = own + (1 - a) * b * both + (1 - a) * (1 - b) * both
    with np.errstate(all="ignore"):
        shared = np.where(all_ > 0, own / all_, 0.0)
    return np.where(bits[0] > 0, np.where(bits[1] > 0, shared, 1.0), 0.0)


def sample_difference(bits: list[np.ndarray], flips: list[float], sketch: LiquidLegions, rng: np.random.Generator) -> np.ndarray:
    if len(bits) != 2:
        raise ValueError("a difference takes two sketches")
    clean = sample(bits, flips, sketch, rng) if any(flips) else bits
    return (rng.random(sketch.length) < difference_probabilities(clean, sketch)).astype(np.float64)


def sequential_prefixes(noised: DataFrame, sets: DataFrame, sketch: LiquidLegions, flip: float, seed: int = 0) -> DataFrame:
    """(run_index, num_sets, estimate): each next sketch is cleaned against what is merged so far."""
    all_ = with_empty_sets(noised.where("value > 0").select("run_index", "set_index", "register", "value"), sets)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        run = int(rows["run_index"].iloc[0])
        rng = np.random.default_rng(h60_value("posterior", seed, run))
        state, first, out = None, None, []
        for i, (n, own) in enumerate(rows.groupby("set_index")):
            bits = vectors(own[own["register"] >= 0], sketch.length)
            if i == 0:
                first = bits
                (merged,) = sample([bits], [flip], sketch, rng)
            elif i == 1:
                one, two = sample([first, bits], [flip, flip], sketch, rng)
                state = merged = np.maximum(one, two)
            else:
                _, clean = sample([state, bits], [0.0, flip], sketch, rng)
                state = merged = np.maximum(state, clean)
            active = min(float(merged.sum()), sketch.length - 1)
            out.append((run, int(n), float(invert_exponential([active], sketch.length, sketch.decay_rate)[0])))
        return pd.DataFrame(out, columns=["run_index", "num_sets", "estimate"])

    return all_.groupBy("run_index").applyInPandas(fold, "run_index int, num_sets int, estimate double")
