"""Sketches: DataFrame aggregations from impressions to register tables.

Input rows are (run_index, set_index, id). A sketch is a long table with one row per
non-empty register, keyed by run, set and register, so all runs and sets are built in one
shuffle, partial aggregates are combined before it, and merging is the same aggregation again.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions import distributions as dist
from tallyspark.functions.hashing import fan_out, fingerprint, hash_id, unit

KEYS = ("run_index", "set_index")


@dataclass(frozen=True, kw_only=True)
class Sketch:
    """Parameters of a sketch; `build` makes its registers. Equal parameters mean mergeable."""

    seed: int = 0
    hash_kind: str = "portable"

    def build(self, df: DataFrame, *more_keys: str) -> DataFrame:
        raise NotImplementedError

    def merge(self, registers: DataFrame, *keys: str) -> DataFrame:
        """Union of all sketches that share the keys."""
        raise NotImplementedError

    def check_compatible(self, other: Sketch) -> None:
        """Raise unless sketches of both can be merged: same kind, parameters, seed and hash."""
        if type(self) is not type(other):
            raise ValueError(f"a {type(self).__name__} can't be merged with a {type(other).__name__}")
        for f in fields(self):
            if getattr(self, f.name) != getattr(other, f.name):
                raise ValueError(f"sketches differ in {f.name}: {getattr(self, f.name)} and {getattr(other, f.name)}")

    def seeded(self, seed: int) -> Sketch:
        return replace(self, seed=seed)

    def hashed(self, modulus: int | None = None) -> Column:
        return hash_id(F.col("id"), self.seed, self.hash_kind, modulus)


def by(keys: tuple[str, ...], more: tuple[str, ...]) -> list[str]:
    return [*keys, *more]


@dataclass(frozen=True, kw_only=True)
class ExactMultiSet(Sketch):
    """(id, frequency): how often each id was seen."""

    def build(self, df: DataFrame, *more_keys: str) -> DataFrame:
        return df.groupBy(*KEYS, *more_keys, "id").agg(F.count("*").alias("frequency"))

    def merge(self, registers: DataFrame, *keys: str) -> DataFrame:
        return registers.groupBy(*keys, "id").agg(F.sum("frequency").alias("frequency"))


@dataclass(frozen=True, kw_only=True)
class AnySketch(Sketch):
    """One register axis per distribution; each insert applies one value function.

    value is 'or' (presence), 'sum' (insertions) or 'unique' (the key plus one while a
    single key has been seen, then -1).
    """

    distributions: tuple[dist.Distribution, ...]
    num_hashes: int = 1
    value: str = "or"

    def __post_init__(self) -> None:
        if self.value not in ("or", "sum", "unique"):
            raise ValueError(f"exactly one value function is needed: or, sum or unique, not {self.value!r}")

    @property
    def max_size(self) -> int:
        size = 1
        for d in self.distributions:
            size *= d.length
        return size

    @property
    def axes(self) -> list[str]:
        return ["register"] if len(self.distributions) == 1 else [f"register_{a}" for a in range(len(self.distributions))]

    def placed(self, df: DataFrame) -> DataFrame:
        """Each row once per hash function, with its register on every axis."""
        seeds = fan_out(self.seed, self.num_hashes, len(self.distributions))
        if self.num_hashes == 1 and len(self.distributions) == 1:
            seeds = [[self.seed]]
        if self.num_hashes == 1:
            return df.withColumns({a: d.index_of_hash(hash_id(F.col("id"), s, self.hash_kind)) for a, d, s in zip(self.axes, self.distributions, seeds[0])})
        places = F.array(*[F.struct(*[d.index_of_hash(hash_id(F.col("id"), s, self.hash_kind)).alias(a) for a, d, s in zip(self.axes, self.distributions, own)]) for own in seeds])
        return df.withColumn("place", F.explode(places)).select("*", "place.*").drop("place")

    def build(self, df: DataFrame, *more_keys: str) -> DataFrame:
        rows = self.placed(df).groupBy(*KEYS, *more_keys, *self.axes)
        if self.value == "unique":
            one = F.when(F.min("id") == F.max("id"), F.min("id") + 1).otherwise(F.lit(-1).cast("long"))
            return rows.agg(one.alias("value"))
        return rows.agg((F.lit(1) if self.value == "or" else F.count("*")).cast("double").alias("value"))

    def merge(self, registers: DataFrame, *keys: str) -> DataFrame:
        rows = registers.groupBy(*keys, *self.axes)
        if self.value == "unique":
            return rows.agg(F.when(F.min("value") == F.max("value"), F.min("value")).otherwise(F.lit(-1).cast("long")).alias("value"))
        return rows.agg((F.max("value") if self.value == "or" else F.sum("value")).alias("value"))

    def contains(self, registers: DataFrame, candidates: DataFrame) -> DataFrame:
        """The candidates (id) whose registers are all set, with the sketch's keys: members and false positives."""
        placed = self.placed(candidates.select("id").distinct())
        hit = placed.join(registers.where("value > 0"), self.axes).groupBy(*KEYS, "id").agg(F.count("*").alias("hits"))
        # two hash functions of an id may fall on one register, which then counts twice on both sides
        return hit.where(F.col("hits") >= self.num_hashes).drop("hits")


def bloom_filter(length: int, num_hashes: int = 1, seed: int = 0, hash_kind: str = "portable") -> AnySketch:
    return AnySketch(distributions=(dist.Uniform(length),), num_hashes=num_hashes, seed=seed, hash_kind=hash_kind)


def uniform_filter(length: int, **options) -> AnySketch:
    return AnySketch(distributions=(dist.Uniform(length),), **options)


def geometric_filter(length: int, probability: float, **options) -> AnySketch:
    return AnySketch(distributions=(dist.Geometric(length, probability),), **options)


def logarithmic_filter(length: int, **options) -> AnySketch:
    return AnySketch(distributions=(dist.LogBucket(length),), **options)


def exponential_filter(length: int, decay_rate: float, **options) -> AnySketch:
    return AnySketch(distributions=(dist.Exponential(length, decay_rate),), **options)


def counting_filter(length: int, **options) -> AnySketch:
    """Counts insertions, not distinct ids."""
    return AnySketch(distributions=(dist.Uniform(length),), value="sum", **options)


class Fingerprints(Sketch):
    """Registers with a count of insertions and the least and greatest fingerprint seen:
    equal ones mean that a single key was seen."""

    def register(self) -> Column:
        raise NotImplementedError

    def build(self, df: DataFrame, *more_keys: str) -> DataFrame:
        rows = df.withColumns({"register": self.register(), "fp": fingerprint(F.col("id"), self.seed, self.hash_kind)})
        return rows.groupBy(*KEYS, *more_keys, "register").agg(F.count("*").alias("cnt"), F.min("fp").alias("min_fp"), F.max("fp").alias("max_fp"))

    def merge(self, registers: DataFrame, *keys: str) -> DataFrame:
        return registers.groupBy(*keys, "register").agg(F.sum("cnt").alias("cnt"), F.min("min_fp").alias("min_fp"), F.max("max_fp").alias("max_fp"))


@dataclass(frozen=True, kw_only=True)
class LiquidLegions(Fingerprints):
    decay_rate: float = 10.0
    length: int = 100_000

    def register(self) -> Column:
        return dist.truncated_exponential_index(unit(self.hashed()), self.decay_rate, self.length)


@dataclass(frozen=True, kw_only=True)
class CascadingLegions(Fingerprints):
    legions: int = 20
    positions: int = 1000

    def register(self) -> Column:
        return dist.cascading_index(fingerprint(F.col("id"), self.seed, self.hash_kind), self.legions, self.positions)


@dataclass(frozen=True, kw_only=True)
class VectorOfCounts(Sketch):
    """Distinct ids per hash bucket."""

    num_buckets: int = 4096

    def build(self, df: DataFrame, *more_keys: str) -> DataFrame:
        distinct = df.select(*KEYS, *more_keys, "id").distinct()
        return distinct.groupBy(*KEYS, *more_keys, self.hashed(self.num_buckets).cast("int").alias("register")).agg(F.count("*").cast("double").alias("value"))

    def dense(self, registers: DataFrame, *keys: str) -> DataFrame:
        """(stats): all buckets as one array per sketch; its length is a parameter, so bounded."""
        own = list(keys or KEYS)
        packed = registers.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("register", "value"))).alias("m"))
        return packed.select(*own, F.transform(F.sequence(F.lit(0), F.lit(self.num_buckets - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("stats"))


@dataclass(frozen=True, kw_only=True)
class HyperLogLog(Sketch):
    """(register, rank), and per sketch the distinct ids while they are few."""

    length: int = 16384
    hash_bits: int = 60

    def __post_init__(self) -> None:
        if self.length & (self.length - 1) or not 16 <= self.length <= 65536:
            raise ValueError("the length is a power of two from 2^4 to 2^16")

    @property
    def index_bits(self) -> int:
        return self.length.bit_length() - 1

    @property
    def sparse_limit(self) -> int:
        return 6 * self.length

    def ranked(self, df: DataFrame) -> DataFrame:
        register, rank = dist.leading_zero_rank(self.hashed(), self.index_bits, self.hash_bits)
        return df.withColumns({"register": register, "rho": rank})

    def build(self, df: DataFrame, *more_keys: str) -> DataFrame:
        return self.ranked(df).groupBy(*KEYS, *more_keys, "register").agg(F.max("rho").alias("rho"))

    def merge(self, registers: DataFrame, *keys: str) -> DataFrame:
        return registers.groupBy(*keys, "register").agg(F.max("rho").alias("rho"))


@dataclass(frozen=True, kw_only=True)
class FreqLogLog(HyperLogLog):
    """Per register the greatest (rank, fingerprint) and how often that pair was seen."""

    max_frequency: int = 15

    def build(self, df: DataFrame, *more_keys: str) -> DataFrame:
        rows = self.ranked(df).withColumn("fp", fingerprint(F.col("id"), self.seed + 1, self.hash_kind))
        counts = rows.groupBy(*KEYS, *more_keys, "register", "rho", "fp").agg(F.count("*").alias("freq"))
        return self.greatest(counts, *KEYS, *more_keys)

    def greatest(self, counts: DataFrame, *keys: str) -> DataFrame:
        top = counts.groupBy(*keys, "register").agg(F.max(F.struct("rho", "fp", "freq")).alias("top"))
        return top.select(*keys, "register", "top.rho", "top.fp", "top.freq")

    def merge(self, registers: DataFrame, *keys: str) -> DataFrame:
        return self.greatest(registers.groupBy(*keys, "register", "rho", "fp").agg(F.sum("freq").alias("freq")), *keys)


@dataclass(frozen=True, kw_only=True)
class SameKeyAggregator(Sketch):
    """Exponential registers that keep the least and greatest key and the insertions:
    a register with one key has that key's frequency."""

    length: int = 100_000
    decay_rate: float = 10.0

    def build(self, df: DataFrame, *more_keys: str) -> DataFrame:
        index = dist.Exponential(self.length, self.decay_rate).index_of_hash(self.hashed())
        rows = df.withColumn("register", index).groupBy(*KEYS, *more_keys, "register")
        return rows.agg(F.min("id").alias("min_key"), F.max("id").alias("max_key"), F.count("*").alias("cnt"))

    def merge(self, registers: DataFrame, *keys: str) -> DataFrame:
        return registers.groupBy(*keys, "register").agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.sum("cnt").alias("cnt"))


def strata(frequencies: DataFrame, max_frequency: int, union: bool = True) -> DataFrame:
    """(stratum, id) from (id, frequency): '1' .. 'K-1', 'K+', and with union also '1+'."""
    level = F.when(F.col("frequency") >= max_frequency, F.lit(f"{max_frequency}+")).otherwise(F.col("frequency").cast("string"))
    keys = [c for c in frequencies.columns if c not in ("frequency", "id")]
    if not union:
        return frequencies.select(*keys, level.alias("stratum"), "id")
    return frequencies.select(*keys, F.explode(F.array(level, F.lit("1+"))).alias("stratum"), "id")


@dataclass(frozen=True, kw_only=True)
class Stratified(Sketch):
    """One sub-sketch per frequency level, and one of all ids."""

    inner: Sketch
    max_frequency: int = 5

    def build(self, df: DataFrame, *more_keys: str) -> DataFrame:
        exact = ExactMultiSet().build(df, *more_keys)
        return self.from_frequencies(exact, *more_keys)

    def from_frequencies(self, frequencies: DataFrame, *more_keys: str) -> DataFrame:
        """From an exact multiset (id, frequency)."""
        return self.inner.build(strata(frequencies, self.max_frequency), *more_keys, "stratum")


def pooled_strata(df: DataFrame, stratified: Stratified) -> DataFrame:
    """One stratified sketch of all of a run's sets together: frequencies are added over the sets first.

    df is what a generator makes, (run_index, set_index, id); the result has set_index 0.
    """
    return stratified.build(df.select("run_index", F.lit(0).alias("set_index"), "id"))
