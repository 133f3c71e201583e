"""Methods: a sketch, an estimator and optional noise, as one plan from impressions to
k+ reach estimates of every prefix of the sets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tallyspark.functions.hashing import h60_value
from tallyspark.functions.numerics import flip_probability
from tallyspark.operators import estimators as est, folds, noisers, posterior, prefixes, setalgebra as alg
from tallyspark.operators.sketches import (
    AnySketch,
    CascadingLegions,
    FreqLogLog,
    HyperLogLog,
    LiquidLegions,
    SameKeyAggregator,
    Stratified,
    VectorOfCounts,
)

Estimate = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Method:
    """estimate(impressions, seed) gives (run_index, num_sets, estimate) or, with several levels, also
    frequency_level. All runs of a plan share one hash seed; `simulate.apart` keeps their hashes independent."""

    name: str
    estimate: Estimate
    max_frequency: int = 1
    estimate_noise: dict = field(default_factory=dict)
    parts: dict = field(default_factory=dict)

    def levels(self, impressions: DataFrame, seed: int, max_frequency: int | None = None) -> DataFrame:
        """(run_index, num_sets, frequency_level, estimate), cut or filled with zeros to max_frequency
        levels; then the estimates' own noise, drawn for each level."""
        top = max_frequency or self.max_frequency
        found = self.estimate(impressions, seed)
        if "frequency_level" not in found.columns:
            found = found.withColumn("frequency_level", F.lit(1))
        grid = prefixes.set_grid(impressions).withColumn("frequency_level", F.explode(F.sequence(F.lit(1), F.lit(top))))
        full = grid.join(found, ["run_index", "num_sets", "frequency_level"], "left").withColumn("estimate", F.coalesce("estimate", F.lit(0.0)))
        return noisers.noised_levels(full, seed=h60_value("global", seed) % (1 << 31), **self.estimate_noise) if self.estimate_noise else full


def filter_method(sketch: AnySketch, local_epsilon: float | None = None, how: str = "first_moment") -> Estimate:
    """A filter with its first-moment (or union) estimate, through random response if local."""

    def estimate(df: DataFrame, seed: int) -> DataFrame:
        own = sketch.seeded(seed)
        registers, grid = own.build(df), prefixes.set_grid(df)
        if local_epsilon is None:
            return est.filter_prefixes(registers, grid, own, how)
        noised = noisers.blip(registers, df, own.max_size, local_epsilon, seed, own.num_hashes)
        return est.denoised_prefixes(noisers.denoise(noised, local_epsilon), grid, own, how)

    return estimate


def voc_method(num_buckets: int, local_epsilon: float | None = None, clip: bool = False) -> Estimate:
    def estimate(df: DataFrame, seed: int) -> DataFrame:
        registers = VectorOfCounts(num_buckets=num_buckets, seed=seed).build(df)
        if local_epsilon is not None:
            registers = noisers.noised_counts(registers, df, num_buckets, local_epsilon, seed)
        return folds.voc_prefixes(registers, df, num_buckets, alg.CountAlgebra(clip, local_epsilon or float("inf")))

    return estimate


def independent_method(universe_size: int, local_epsilon: float | None = None) -> Estimate:
    """Each set's reach from a single noised count, combined as independent sets."""

    def estimate(df: DataFrame, seed: int) -> DataFrame:
        registers = VectorOfCounts(num_buckets=1, seed=seed).build(df)
        if local_epsilon is not None:
            registers = noisers.noised_counts(registers, df, 1, local_epsilon, seed)
        return est.independent_reach(registers.select("run_index", "set_index", F.col("value").alias("reach")), universe_size)

    return estimate


def hll_method(length: int = 16384) -> Estimate:
    return lambda df, seed: est.hll_prefixes(df, HyperLogLog(length=length, seed=seed))


def fll_method(length: int = 16384) -> Estimate:
    return lambda df, seed: est.fll_prefixes(df, FreqLogLog(length=length, seed=seed))


def liquid_method(decay_rate: float = 10.0, length: int = 100_000, flip: float | None = None, sequential: bool = False) -> Estimate:
    def estimate(df: DataFrame, seed: int) -> DataFrame:
        sketch = LiquidLegions(decay_rate=decay_rate, length=length, seed=seed)
        registers, grid = sketch.build(df), prefixes.set_grid(df)
        if flip is None and not sequential:
            return est.liquid_prefixes(registers, grid, sketch)
        noised = noisers.noised_legions(registers, df, length, flip or 0.0, seed)
        if sequential:
            return posterior.sequential_prefixes(noised, df, sketch, flip or 0.0, seed)
        return est.noised_liquid_prefixes(noised, grid, sketch, flip)

    return estimate


def cascading_method(legions: int, positions: int, flip: float | None = None) -> Estimate:
    def estimate(df: DataFrame, seed: int) -> DataFrame:
        sketch = CascadingLegions(legions=legions, positions=positions, seed=seed)
        registers, grid = sketch.build(df), prefixes.set_grid(df)
        if flip is None:
            return est.cascading_prefixes(registers, grid, sketch)
        return est.noised_cascading_prefixes(noisers.noised_legions(registers, df, legions * positions, flip, seed), grid, sketch, flip)

    return estimate


def meta_voc_method(sketch: AnySketch, voc_length: int, local_epsilon: float | None = None) -> Estimate:
    """A vector of counts over the filter's active registers, noised, stands for the filters' union."""
    inner = voc_method(voc_length, local_epsilon)

    def estimate(df: DataFrame, seed: int) -> DataFrame:
        own = sketch.seeded(seed)
        return est.meta_prefixes(own.build(df), own, lambda ids: inner(ids, seed + 1))

    return estimate


def exact_method(max_frequency: int) -> Estimate:
    def estimate(df: DataFrame, seed: int) -> DataFrame:
        levels = prefixes.level_reach(df, max_frequency)
        return levels.select("run_index", "num_sets", "frequency_level", F.col("cardinality").cast("double").alias("estimate"))

    return estimate


def stratified_voc_method(length: int, max_frequency: int, local_epsilon: float | None = None, clip: bool = False) -> Estimate:
    def estimate(df: DataFrame, seed: int) -> DataFrame:
        registers = Stratified(inner=VectorOfCounts(num_buckets=length, seed=seed), max_frequency=max_frequency).build(df)
        if local_epsilon is not None:
            registers = noisers.noised_counts(registers, all_strata(df, max_frequency), length, local_epsilon, seed, "stratum")
        return folds.stratified_prefixes(registers, df, length, max_frequency, alg.StratifiedCountAlgebra(clip, local_epsilon or float("inf")))

    return estimate


def all_strata(df: DataFrame, max_frequency: int) -> DataFrame:
    names = [str(k) for k in range(1, max_frequency)] + [f"{max_frequency}+", "1+"]
    return df.select("run_index", "set_index").distinct().withColumn("stratum", F.explode(F.array(*map(F.lit, names))))


def stratified_filter_method(sketch: AnySketch, max_frequency: int, kind: str = "expectation", local_epsilon: float | None = None, split: float = 0.5) -> Estimate:
    """Strata of filters; noise takes the budget's split for everyone's stratum and the rest for the others,
    and each is denoised with its own."""

    def estimate(df: DataFrame, seed: int) -> DataFrame:
        own = sketch.seeded(seed)
        length = own.max_size
        registers = Stratified(inner=own, max_frequency=max_frequency).build(df)
        if local_epsilon is not None:
            union_epsilon, level_epsilon = noisers.budget_split(local_epsilon, split)
            dense = noisers.dense(registers, all_strata(df, max_frequency), length, "value", "stratum")
            p = F.when(F.col("stratum") == "1+", F.lit(flip_probability(union_epsilon))).otherwise(F.lit(flip_probability(level_epsilon)))
            u = noisers.flip_bit(F.col("value"), p, p, seed, *noisers.at("stratum"))
            registers = dense.withColumn("value", (u - p) / (1 - 2 * p))
        algebra = alg.FilterAlgebra(own.distributions[0], kind)
        return folds.stratified_prefixes(registers, df, length, max_frequency, algebra)

    return estimate


def ska_method(length: int, decay_rate: float, max_frequency: int, epsilon: float | None = None, noise: str = "geometric") -> Estimate:
    def estimate(df: DataFrame, seed: int) -> DataFrame:
        sketch = SameKeyAggregator(length=length, decay_rate=decay_rate, seed=seed)
        spent = {} if epsilon is None else {"reach_noise": noise, "reach_epsilon": epsilon, "frequency_noise": noise, "frequency_epsilon": epsilon}
        return est.ska_prefixes(sketch.build(df), prefixes.set_grid(df), sketch, max_frequency, seed=seed, **spent)

    return estimate
