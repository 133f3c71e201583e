"""Simulation: all runs of a scenario under a method, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspark.functions.hashing import h60, h60_value
from tallyspark.operators import prefixes
from tallyspark.plans.methods import Method
from tallyspark.sources.generators import Generator


def relative_error(estimate: Column, truth: Column) -> Column:
    """(estimate - truth) / truth; at truth 0 NaN for 0 and infinity otherwise, as IEEE has it."""
    off = (estimate - truth).cast("double")
    none = F.when(off == 0, F.lit(float("nan"))).when(off > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(truth == 0, none).otherwise(off / F.when(truth == 0, F.lit(1.0)).otherwise(truth.cast("double")))


def shuffle_distance(one: Column, two: Column) -> Column:
    """Half the summed difference of two k+ histograms' per-frequency proportions, padded to one
    length; raises for empty ones."""
    size = F.greatest(F.size(one), F.size(two))

    def shares(h: Column) -> Column:
        full = F.transform(F.sequence(F.lit(0), size), lambda i: F.coalesce(F.get(h, i), F.lit(0)).cast("double"))
        first = F.get(full, F.lit(0))
        return F.transform(F.slice(full, F.lit(1), size), lambda x, i: F.when(first == 0, F.lit(0.0)).otherwise((x - F.get(full, i + 1)) / F.when(first == 0, F.lit(1.0)).otherwise(first)))

    total = F.aggregate(F.zip_with(shares(one), shares(two), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    empty = (F.size(one) == 0) | (F.size(two) == 0)
    return F.when(empty, F.raise_error(F.lit("a histogram is empty")).cast("double")).otherwise(total / 2)


def extend_histogram(h: Column, length: int) -> Column:
    """Cut, or filled with zeros, to a length."""
    return F.slice(F.concat(h, F.array_repeat(F.lit(0).cast("double"), length)), 1, length)


def apart(impressions: DataFrame, seed: int) -> DataFrame:
    """The same impressions, in which each run after the first has its own names for the ids: a run's mask, drawn from the seed,
    turns some of their bits. One id stays one id, so reach and frequencies are as before, but a plan's
    hash functions, which share a seed, are independent between runs, also where all runs reach the same people."""
    mask = h60(seed, "run", F.col("run_index"))
    return impressions.withColumn("id", F.when(F.col("run_index") == 0, F.col("id")).otherwise(F.col("id").bitwiseXOR(mask)))


def raw_results(impressions: DataFrame, method: Method, seed: int, max_frequency: int | None = None, *, shared_seed: bool = False) -> DataFrame:
    """One row per run and prefix: num_sets, estimated_cardinality_k and true_cardinality_k for each level,
    shuffle_distance, run_index, relative_error_k. Each run's sketches have a hash seed of their own, unless shared_seed."""
    top = max_frequency or method.max_frequency
    found = method.levels(impressions if shared_seed else apart(impressions, seed), seed, top)
    truth = prefixes.level_reach(impressions, top)
    keys = ["run_index", "num_sets"]
    both = found.join(truth, [*keys, "frequency_level"])
    ks = range(1, top + 1)
    at = lambda c, k: F.max(F.when(F.col("frequency_level") == k, F.col(c)))
    wide = both.groupBy(*keys).agg(*[at("estimate", k).cast("double").alias(f"estimated_cardinality_{k}") for k in ks], *[at("cardinality", k).cast("long").alias(f"true_cardinality_{k}") for k in ks])
    estimated, true = (F.array(*[F.col(f"{w}_cardinality_{k}").cast("double") for k in ks]) for w in ("estimated", "true"))
    errors = [relative_error(F.col(f"estimated_cardinality_{k}"), F.col(f"true_cardinality_{k}")).alias(f"relative_error_{k}") for k in ks]
    return wide.select("num_sets", *[f"estimated_cardinality_{k}" for k in ks], *[f"true_cardinality_{k}" for k in ks], shuffle_distance(estimated, true).alias("shuffle_distance"), "run_index", *errors)


def aggregated(raw: DataFrame) -> DataFrame:
    """Mean and standard deviation (of the sample) of each metric by num_sets."""
    metrics = [c for c in raw.columns if c.startswith(("estimated_", "true_", "relative_error_")) or c == "shuffle_distance"]
    return raw.groupBy("num_sets").agg(*[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def simulate(spark: SparkSession, generator: Generator, method: Method, num_runs: int, *, data_seed: int = 1, sketch_seed: int = 2, max_frequency: int | None = None, shared_seed: bool = False) -> DataFrame:
    """Raw results of num_runs runs. Data depend on data_seed alone, so all methods see the same."""
    impressions = generator.generate(spark, num_runs, data_seed)
    return raw_results(impressions, method, sketch_seed_of(sketch_seed), max_frequency, shared_seed=shared_seed)


def sketch_seed_of(seed: int) -> int:
    """The seed of a simulation's sketches, apart from that of its data."""
    return h60_value("sketch", seed) % (1 << 31)
