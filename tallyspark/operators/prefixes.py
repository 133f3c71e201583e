"""Statistics of the unions of sets 1 .. n, for every n at once.

The reference quantity is always a union over a prefix of the sets. Merging each prefix anew
is quadratic in the sets; here each register (or id) is charged to the set at which it
first counts, and a running sum over the sets finishes: one shuffle, linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def set_grid(df: DataFrame) -> DataFrame:
    """(run_index, num_sets): every set of every run."""
    return df.select("run_index", F.col("set_index").alias("num_sets")).distinct()


def running(per_set: DataFrame, grid: DataFrame, columns: list[str], *more_keys: str) -> DataFrame:
    """Running sums over num_sets, with a row for each set of the grid."""
    keys = ["run_index", *more_keys]
    full = grid.join(per_set, ["num_sets", *keys] if more_keys else ["run_index", "num_sets"], "left")
    order = Window.partitionBy(*keys).orderBy("num_sets").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return full.select(*keys, "num_sets", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(c) for c in columns])


def active_registers(registers: DataFrame, grid: DataFrame) -> DataFrame:
    """(run_index, num_sets, active): registers set in any of the first n sketches."""
    first = registers.groupBy("run_index", "register").agg(F.min("set_index").alias("num_sets"))
    per_set = first.groupBy("run_index", "num_sets").agg(F.count("*").alias("active"))
    return running(per_set, grid, ["active"])


def level_reach(df: DataFrame, max_frequency: int) -> DataFrame:
    """(run_index, num_sets, frequency_level, cardinality): exact ids seen k times or more
    in the first n sets, for k up to max_frequency."""
    counts = df.groupBy("run_index", "id", "set_index").agg(F.count("*").alias("n"))
    order = Window.partitionBy("run_index", "id").orderBy("set_index")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumn("upto", F.least(upto, F.lit(max_frequency))).withColumn("before", F.coalesce(F.lag("upto").over(order), F.lit(0)))
    # each id reaches each level at one set
    reached = counts.where("upto > before").select("run_index", F.col("set_index").alias("num_sets"), F.explode(F.sequence((F.col("before") + 1).cast("int"), F.col("upto").cast("int"))).alias("frequency_level"))
    per_set = reached.groupBy("run_index", "num_sets", "frequency_level").agg(F.count("*").alias("cardinality"))
    grid = set_grid(df).withColumn("frequency_level", F.explode(F.sequence(F.lit(1), F.lit(max_frequency))))
    return running(per_set, grid, ["cardinality"], "frequency_level")


def harmonic_sums(registers: DataFrame, grid: DataFrame) -> DataFrame:
    """(run_index, num_sets, active, powers): registers and the sum of 2^-rank over them, of the
    union of the first n sketches, by the changes that each set makes to the greatest ranks."""
    order = Window.partitionBy("run_index", "register").orderBy("set_index")
    top = registers.withColumn("top", F.max("rho").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    top = top.withColumn("before", F.lag("top").over(order)).where("before is null or top > before")
    power = lambda c: F.pow(F.lit(2.0), -F.col(c))
    change = power("top") - F.coalesce(power("before"), F.lit(0.0))
    per_set = top.groupBy("run_index", F.col("set_index").alias("num_sets")).agg(F.sum(F.when(F.col("before").isNull(), 1).otherwise(0)).alias("active"), F.sum(change).alias("powers"))
    return running(per_set, grid, ["active", "powers"])


def distinct_ids(df: DataFrame, grid: DataFrame) -> DataFrame:
    """(run_index, num_sets, ids)."""
    first = df.groupBy("run_index", "id").agg(F.min("set_index").alias("num_sets"))
    return running(first.groupBy("run_index", "num_sets").agg(F.count("*").alias("ids")), grid, ["ids"])


def merged_prefixes(registers: DataFrame, grid: DataFrame, merge) -> DataFrame:
    """The merged registers of every prefix, for sketches whose statistics need the whole state:
    each register once for every n from its set on."""
    later = registers.join(grid, "run_index").where(F.col("num_sets") >= F.col("set_index"))
    return merge(later, "run_index", "num_sets")


def fuzzy_or(values: DataFrame, grid: DataFrame, value: Column | str = "value") -> DataFrame:
    """(run_index, num_sets, active): sum over registers of 1 - product(1 - v) over the first n
    sketches, for dense registers of any real values, such as denoised bits."""
    order = Window.partitionBy("run_index", "register").orderBy("set_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    col = F.col(value) if isinstance(value, str) else value
    united = values.withColumn("u", 1 - F.product(1 - col).over(order))
    return united.groupBy("run_index", F.col("set_index").alias("num_sets")).agg(F.sum("u").alias("active"))
