"""Set and multiset generators: reproducible impressions (run_index, set_index, id).

Sampling is by hash: the hashes of (seed, run, set, number of the draw) are the draws, so sizes
are exact, nothing depends on partitioning, and another SQL engine draws the same sample.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyspark.functions.hashing import h60, h60_value, uniform
from tallyspark.functions.numerics import truncated_poisson

ORDERS = ("original", "reversed", "random")


def runs_and_sets(spark: SparkSession, runs: int, sizes: list[int]) -> DataFrame:
    """(run_index, set_index, set_size): one row per set of every run."""
    rows = spark.range(runs).select(F.col("id").cast("int").alias("run_index"))
    return rows.select("run_index", F.posexplode(F.array(*[F.lit(int(s)) for s in sizes])).alias("p", "set_size")).select("run_index", (F.col("p") + 1).cast("int").alias("set_index"), "set_size")


def hash_ranked(rows: DataFrame, keys: list[str], order: Column, size: Column) -> DataFrame:
    """The `size` rows of each group with the least order, ties by id."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= size).drop("_place")


def sampled(spark: SparkSession, runs: int, sizes: list[int], universe_size: int, seed: int, label: str = "set") -> DataFrame:
    """(run_index, set_index, id): sizes[i] ids of each set, without replacement, from range(universe_size).

    Ids are drawn with replacement, by the hash of their number, until there are enough different ones; the first of these make the
    set. So a set of m costs about m draws, however large the universe is: universe * ln(universe / (universe - m)) are expected,
    and 8 deviations more are made. A set of over half the universe is everything but a sample of the rest.
    """
    if max(sizes, default=0) > universe_size:
        raise ValueError(f"a set of {max(sizes)} doesn't fit in a universe of {universe_size}")
    most = [universe_size - s if 2 * s > universe_size else s for s in sizes]
    draws = [u + 8 * np.sqrt(u) + 64 if u else 0 for u in (-universe_size * np.log1p(-m / universe_size) for m in most)]
    rows = runs_and_sets(spark, runs, [int(np.ceil(d)) for d in draws]).where("set_size > 0").withColumn("t", F.explode(F.sequence(F.lit(1).cast("long"), F.col("set_size").cast("long"))))
    drawn = rows.select("run_index", "set_index", F.pmod(h60(seed, label, F.col("run_index"), F.col("set_index"), F.col("t")), F.lit(universe_size)).alias("id"), "t")
    firsts = drawn.groupBy("run_index", "set_index", "id").agg(F.min("t").alias("t"))
    size = F.element_at(F.array(*[F.lit(int(m)) for m in most]), F.col("set_index"))
    place = F.row_number().over(Window.partitionBy("run_index", "set_index").orderBy("t"))
    chosen = firsts.withColumn("_place", place).where(F.col("_place") <= size).select("run_index", "set_index", "id")
    large = [i + 1 for i, s in enumerate(sizes) if 2 * s > universe_size]
    if not large:
        return chosen
    all_ = runs_and_sets(spark, runs, sizes).where(F.col("set_index").isin(large)).select("run_index", "set_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(universe_size - 1).cast("long"))).alias("id"))
    return chosen.where(~F.col("set_index").isin(large)).unionAll(all_.join(chosen, ["run_index", "set_index", "id"], "left_anti"))


def pool_positions(spark: SparkSession, runs: int, size: int, universe_size: int | None, seed: int) -> DataFrame:
    """(run_index, position, id): a hash permutation of the first `size` of a pool, per run."""
    pool = spark.range(runs).select(F.col("id").cast("int").alias("run_index")).withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((universe_size or size) - 1).cast("long"))))
    order = Window.partitionBy("run_index").orderBy(h60(seed, "pool", F.col("run_index"), F.col("id")), "id")
    return pool.withColumn("position", F.row_number().over(order) - 1).where(F.col("position") < size)


def reordered(order: str, n: int, seed: int) -> Column:
    """The new number of set_index under an order; random ones differ by run."""
    if order not in ORDERS:
        raise ValueError(f"order is one of {ORDERS}, not {order!r}")
    if order == "original":
        return F.col("set_index")
    if order == "reversed":
        return (F.lit(n + 1) - F.col("set_index")).cast("int")
    numbers = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(h60(seed, "order", F.col("run_index"), i).alias("h"), i.alias("i")))
    return F.array_position(F.transform(F.array_sort(numbers), lambda s: s["i"]), F.col("set_index")).cast("int")


class Generator:
    """Impressions of `runs` runs; set sizes and number are known at plan time."""

    set_sizes: list[int]

    def generate(self, spark: SparkSession, runs: int, seed: int) -> DataFrame:
        raise NotImplementedError

    @property
    def num_sets(self) -> int:
        return len(self.set_sizes)


@dataclass(frozen=True)
class Independent(Generator):
    universe_size: int
    set_sizes: list[int]

    def generate(self, spark: SparkSession, runs: int, seed: int) -> DataFrame:
        return sampled(spark, runs, self.set_sizes, self.universe_size, seed)


#: The four activity levels of the exponential bow, their shares of people, and the least set.
BOW_SHARES = (0.164, 0.388, 0.312, 0.136)
BOW_LEVELS = (0.065, 0.4274, 1.275, 3.140)
BOW_LEAST_SIZE = 50


@dataclass(frozen=True)
class ExponentialBow(Generator):
    """People differ in activity: those of an activity level are reached at the set's rate times the level.

    association 'identical': a person's level is the same for all sets; 'independent': drawn anew for each.
    A set may fall short where a level's rate exceeds 1.
    """

    association: str
    universe_size: int
    set_sizes: list[int]
    shares: tuple[float, ...] = BOW_SHARES
    levels: tuple[float, ...] = BOW_LEVELS

    def __post_init__(self) -> None:
        if self.association not in ("identical", "independent"):
            raise ValueError(f"association is identical or independent, not {self.association!r}")
        if min(self.set_sizes) < BOW_LEAST_SIZE:
            raise ValueError(f"set sizes are at least {BOW_LEAST_SIZE}")

    def generate(self, spark: SparkSession, runs: int, seed: int) -> DataFrame:
        rows = runs_and_sets(spark, runs, self.set_sizes)
        rows = rows.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.universe_size - 1).cast("long"))))
        group = F.col("id") / float(self.universe_size) if self.association == "identical" else uniform(seed, "bow", F.col("run_index"), F.col("set_index"), F.col("id"))
        ends, starts = np.cumsum(self.shares), np.concatenate([[0], np.cumsum(self.shares)[:-1]])
        stratum, wanted = F.lit(len(self.shares) - 1), F.lit(0)
        for i, (a, b, x) in reversed(list(enumerate(zip(starts, ends, self.levels)))):
            size = F.floor(F.least(F.lit(1.0), F.col("set_size") / float(self.universe_size) * x) * round((b - a) * self.universe_size))
            stratum = F.when(group < float(b), F.lit(i)).otherwise(stratum)
            wanted = F.when(group < float(b), size).otherwise(wanted if i < len(self.shares) - 1 else size)
        rows = rows.withColumns({"stratum": stratum, "wanted": wanted}).where("wanted > 0")
        order = h60(seed, "set", F.col("run_index"), F.col("set_index"), F.col("id"))
        return hash_ranked(rows, ["run_index", "set_index", "stratum"], order, F.col("wanted")).select("run_index", "set_index", "id")


@dataclass(frozen=True)
class FullyOverlapping(Generator):
    universe_size: int
    num_sets_: int
    set_size: int

    @property
    def set_sizes(self) -> list[int]:
        return [self.set_size] * self.num_sets_

    def generate(self, spark: SparkSession, runs: int, seed: int) -> DataFrame:
        one = sampled(spark, runs, [self.set_size], self.universe_size, seed)
        return one.withColumn("set_index", F.explode(F.sequence(F.lit(1), F.lit(self.num_sets_))))


@dataclass(frozen=True)
class Subset(Generator):
    """Equal large sets, and equal small ones inside them."""

    order: str
    universe_size: int
    num_large_sets: int
    num_small_sets: int
    large_set_size: int
    small_set_size: int

    @property
    def set_sizes(self) -> list[int]:
        sizes = [self.large_set_size] * self.num_large_sets + [self.small_set_size] * self.num_small_sets
        return sizes[::-1] if self.order == "reversed" else sizes

    def generate(self, spark: SparkSession, runs: int, seed: int) -> DataFrame:
        large = sampled(spark, runs, [self.large_set_size], self.universe_size, seed)
        again = F.row_number().over(Window.partitionBy("run_index").orderBy(h60(seed, "subset", F.col("run_index"), F.col("id")), "id"))
        n = self.num_large_sets + self.num_small_sets
        rows = large.withColumn("again", again).withColumn("set_index", F.explode(F.sequence(F.lit(1), F.lit(n))))
        rows = rows.where((F.col("set_index") <= self.num_large_sets) | (F.col("again") <= self.small_set_size))
        return rows.select("run_index", reordered(self.order, n, seed).alias("set_index"), "id")


@dataclass(frozen=True)
class SequentiallyCorrelated(Generator):
    """Each set shares a proportion with the previous sets: with 'all' of them together, or with 'one'."""

    order: str
    correlated_sets: str
    shared_prop: float
    set_sizes: list[int]

    def __post_init__(self) -> None:
        if self.correlated_sets not in ("all", "one"):
            raise ValueError(f"correlated_sets is all or one, not {self.correlated_sets!r}")
        if not 0 <= self.shared_prop <= 1:
            raise ValueError(f"a proportion is in [0, 1], not {self.shared_prop}")

    def overlaps(self) -> list[int]:
        """How many ids of each set are shared with those before."""
        out, known = [], 0
        for i, size in enumerate(self.set_sizes):
            before = known if self.correlated_sets == "all" else self.set_sizes[i - 1] if i else 0
            out.append(min(int(size * self.shared_prop), before) if i else 0)
            known += size - out[-1]
        return out

    def generate(self, spark: SparkSession, runs: int, seed: int) -> DataFrame:
        shared, n = self.overlaps(), self.num_sets
        fresh = [s - o for s, o in zip(self.set_sizes, shared)]
        begins = np.concatenate([[0], np.cumsum(fresh)[:-1]]).astype(int)
        total = int(sum(fresh))
        pool = pool_positions(spark, runs, total, None, seed)
        bounds = F.array(*[F.struct(F.lit(i + 1).alias("set_index"), F.lit(int(b)).alias("begin"), F.lit(int(b + f)).alias("end"), F.lit(int(o)).alias("shared")) for i, (b, f, o) in enumerate(zip(begins, fresh, shared))])
        if self.correlated_sets == "one":
            # a set is a slice of the pool that reaches back into the set before
            rows = pool.withColumn("s", F.explode(bounds)).where("position >= s.begin - s.shared and position < s.end")
            rows = rows.select("run_index", F.col("s.set_index").alias("set_index"), "id")
        else:
            own = pool.withColumn("s", F.explode(bounds)).where("position < s.end")
            old = own.where("position < s.begin and s.shared > 0")
            place = F.row_number().over(Window.partitionBy("run_index", "s.set_index").orderBy(h60(seed, "shared", F.col("run_index"), F.col("s.set_index"), F.col("id")), "id"))
            old = old.withColumn("place", place).where("place <= s.shared")
            rows = own.where("position >= s.begin").select("run_index", F.col("s.set_index").alias("set_index"), "id").unionAll(old.select("run_index", F.col("s.set_index").alias("set_index"), "id"))
        return rows.select("run_index", reordered(self.order, n, seed).cast("int").alias("set_index"), "id")


@dataclass(frozen=True)
class Disjoint(Generator):
    """Consecutive ranges of ids."""

    set_sizes: list[int]

    def generate(self, spark: SparkSession, runs: int, seed: int = 0) -> DataFrame:
        offsets = np.concatenate([[0], np.cumsum(self.set_sizes)[:-1]]).astype(int)
        offset = F.element_at(F.array(*[F.lit(int(o)).cast("long") for o in offsets]), F.col("set_index"))
        rows = runs_and_sets(spark, runs, self.set_sizes).where("set_size > 0").withColumn("id", F.explode(F.sequence(offset, offset + F.col("set_size") - 1)))
        return rows.select("run_index", "set_index", "id")


# ---- multisets -----------------------------------------------------------------------------


def repeated(rows: DataFrame, frequency: Column) -> DataFrame:
    """Each row as often as its frequency says."""
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), frequency.cast("int")))).drop("_n")


def by_pmf(u: Column, pmf: np.ndarray) -> Column:
    """1 plus the number of cumulative probabilities below u."""
    ends = np.cumsum(pmf)[:-1]
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]) if len(ends) else F.array().cast("array<double>"), lambda e: e < u)) + 1


@dataclass(frozen=True)
class HomogeneousPmf(Generator):
    """Each id's frequency is drawn from its set's probabilities for 1, 2, .."""

    universe_size: int
    set_sizes: list[int]
    pmfs: list[list[float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if len(self.pmfs) != len(self.set_sizes):
            raise ValueError("one list of probabilities a set is needed")
        if any(abs(sum(p) - 1) > 1e-9 for p in self.pmfs):
            raise ValueError("probabilities sum to 1")

    def generate(self, spark: SparkSession, runs: int, seed: int) -> DataFrame:
        rows = Independent(self.universe_size, self.set_sizes).generate(spark, runs, seed)
        u = uniform(seed, "frequency", F.col("run_index"), F.col("set_index"), F.col("id"))
        frequency = F.lit(1)
        for i, pmf in enumerate(self.pmfs):
            frequency = F.when(F.col("set_index") == i + 1, by_pmf(u, np.asarray(pmf))).otherwise(frequency)
        return repeated(rows, frequency)


def homogeneous(universe_size: int, set_sizes: list[int], freq_rates: list[float], freq_cap: int = 100, inclusive_cap: bool = False) -> HomogeneousPmf:
    """One plus a Poisson number of impressions. As published, a cap of c gives frequencies up to c - 1;
    inclusive_cap makes it c."""
    top = freq_cap if inclusive_cap else freq_cap - 1
    return HomogeneousPmf(universe_size, set_sizes, [truncated_poisson(r, top).tolist() for r in freq_rates])


def negative_binomial(u: Column, shape: float, q: float) -> Column:
    """The number whose cumulative probability first reaches u, without an upper end."""

    @F.pandas_udf("long")
    def inverse(values: pd.Series) -> pd.Series:
        x = values.to_numpy(np.float64)
        size, ends = 1024, np.zeros(0)
        while True:
            k = np.arange(1, size)
            steps = np.concatenate([[shape * np.log1p(-q)], np.log((k - 1 + shape) / k * q)])
            ends = np.cumsum(np.exp(np.cumsum(steps)))
            # rounding may keep the sum below the largest u: then no further term changes it
            if not len(x) or ends[-1] >= x.max() or ends[-1] == ends[size // 2]:
                break
            size *= 2
        return pd.Series(np.searchsorted(ends, x, side="left"))

    return inverse(u)


@dataclass(frozen=True)
class Heterogeneous(Generator):
    """One plus a Poisson number whose rate is gamma distributed over people, optionally capped.

    Shape 1 makes it geometric, in closed form; other shapes invert the negative binomial's
    cumulative probabilities, as far as the uniform numbers reach.
    """

    universe_size: int
    set_sizes: list[int]
    gamma_params: list[tuple[float, float]]
    freq_cap: int | None = None

    def generate(self, spark: SparkSession, runs: int, seed: int) -> DataFrame:
        rows = Independent(self.universe_size, self.set_sizes).generate(spark, runs, seed)
        u = uniform(seed, "frequency", F.col("run_index"), F.col("set_index"), F.col("id"))
        frequency = F.lit(1).cast("long")
        for i, (shape, scale) in enumerate(self.gamma_params):
            q = scale / (1 + scale)
            if shape == 1:
                own = F.floor(F.ln(1 - u) / float(np.log(q))) + 1
            else:
                own = negative_binomial(u, shape, q) + 1
            frequency = F.when(F.col("set_index") == i + 1, own.cast("long")).otherwise(frequency)
        return repeated(rows, F.least(frequency, F.lit(self.freq_cap)) if self.freq_cap else frequency)


@dataclass(frozen=True)
class PublisherConstant(Generator):
    universe_size: int
    set_sizes: list[int]
    frequency: int

    def generate(self, spark: SparkSession, runs: int, seed: int) -> DataFrame:
        return repeated(Independent(self.universe_size, self.set_sizes).generate(spark, runs, seed), F.lit(self.frequency))


@dataclass(frozen=True)
class ParameterSampler:
    """Named parameters, each drawn by its own sampler from a seeded generator."""

    samplers: dict[str, Callable[[np.random.Generator], Any]]

    def __call__(self, seed: int) -> dict[str, Any]:
        return {name: draw(np.random.default_rng(h60_value("parameter", seed, name))) for name, draw in self.samplers.items()}
