"""Noise on sketches and estimates. Each sketch is noised once, keyed by run, set and register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark.functions.hashing import h60
from tallyspark.functions.noise import flip_bit, laplace, noised_estimate, unflip
from tallyspark.functions.numerics import flip_probability


def dense(registers: DataFrame, sets: DataFrame, length: int, value: str = "value", *more_keys: str) -> DataFrame:
    """Every register of every sketch in sets, empty ones as 0: noise may change each of them.

    The rows are made in place, one generator row per sketch, and joined by key.
    """
    keys = ["run_index", "set_index", *more_keys]
    all_ = sets.select(*keys).distinct().withColumn("register", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return all_.join(registers.select(*keys, "register", F.col(value).alias("value")), [*keys, "register"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def at(*more_keys: str) -> list[Column]:
    return [F.col(c) for c in ("run_index", "set_index", *more_keys, "register")]


def flip(registers: DataFrame, sets: DataFrame, length: int, seed: int, rise: float, fall: float | None = None, *more_keys: str) -> DataFrame:
    """Dense 0/1 registers after random response."""
    full = dense(registers, sets, length, "value", *more_keys)
    return full.withColumn("value", flip_bit(F.col("value"), rise, rise if fall is None else fall, seed, *at(*more_keys)))


def blip(registers: DataFrame, sets: DataFrame, length: int, epsilon: float, seed: int, num_hashes: int = 1, *more_keys: str) -> DataFrame:
    """Random response at the flip chance that gives epsilon over num_hashes bits."""
    return flip(registers, sets, length, seed, flip_probability(epsilon, num_hashes), None, *more_keys)


def denoise(noised: DataFrame, epsilon: float | None = None, probability: float | None = None, num_hashes: int = 1) -> DataFrame:
    """Registers whose expectation is the clean bit; they may be negative or over 1."""
    if (epsilon is None) == (probability is None):
        raise ValueError("give either epsilon or probability")
    if num_hashes != 1:
        raise ValueError("denoising is defined for one hash function")
    p = flip_probability(epsilon) if probability is None else probability
    return noised.withColumn("value", unflip(F.col("value").cast("double"), p))


def noised_legions(registers: DataFrame, sets: DataFrame, length: int, probability: float, seed: int) -> DataFrame:
    """Dense 0/1 presence of legion registers after random response. Frequencies don't survive, and
    noise is for presence tables only: a table that has it already has no cnt and is refused."""
    if "cnt" not in registers.columns:
        raise ValueError("these registers are noised already")
    return flip(registers.withColumn("value", (F.col("cnt") > 0).cast("int")), sets, length, seed, probability)


def noised_counts(registers: DataFrame, sets: DataFrame, num_buckets: int, epsilon: float, seed: int, *more_keys: str) -> DataFrame:
    """Vectors of counts with Laplace noise of scale 1 / epsilon in every bucket."""
    full = dense(registers, sets, num_buckets, "value", *more_keys)
    return full.withColumn("value", F.col("value") + laplace(1 / epsilon, seed, *at(*more_keys)))


def identity(registers: DataFrame) -> DataFrame:
    return registers


def add_random_elements(df: DataFrame, count: int, universe_size: int, seed: int) -> DataFrame:
    """Each set with `count` ids more that it didn't hold, drawn without replacement from the universe.

    Draws twice as many candidates as could be needed by collisions, so the count is exact when the universe
    has room for it.
    """
    keys = ["run_index", "set_index"]
    sizes = df.groupBy(*keys).agg(F.count_distinct("id").alias("held"))
    tries = F.ceil((count + F.col("held")) * 2 + 64).cast("int")
    drawn = sizes.withColumn("try", F.explode(F.sequence(F.lit(1), tries)))
    drawn = drawn.select(*keys, F.pmod(h60(seed, "add", *[F.col(k) for k in keys], F.col("try")), F.lit(universe_size)).alias("id"), "try")
    fresh = drawn.groupBy(*keys, "id").agg(F.min("try").alias("try")).join(df.select(*keys, "id").distinct(), [*keys, "id"], "left_anti")
    order = Window.partitionBy(*keys).orderBy("try")
    chosen = fresh.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)
    return df.select(*keys, "id").unionAll(chosen.select(*keys, "id"))


def noised_levels(estimates: DataFrame, kind: str | None, seed: int, *, epsilon: float | None = None, delta: float | None = None, num_queries: int = 1) -> DataFrame:
    """Global noise on every (run, prefix, level) estimate, independently."""
    level = F.col("frequency_level") if "frequency_level" in estimates.columns else F.lit(1)
    value = noised_estimate(F.col("estimate"), kind, seed, F.col("run_index"), F.col("num_sets"), level, epsilon=epsilon, delta=delta, num_queries=num_queries)
    return estimates.withColumn("estimate", value.cast("double"))


def budget_split(epsilon: float, split: float) -> tuple[float, float]:
    """(of the union stratum, of each other stratum); split 0 gives every stratum all of epsilon."""
    if not 0 <= split < 1:
        raise ValueError(f"a split is in [0, 1), not {split}")
    return (epsilon, epsilon) if split == 0 else (epsilon * split, epsilon * (1 - split))
