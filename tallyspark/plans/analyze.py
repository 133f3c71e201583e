"""Analysis of raw results: how many sets can be estimated, and how the errors are distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

KEYS = ("sketch_estimator", "scenario")
#: The metric that each kind of analysis looks at.
METRICS = {"cardinality": "relative_error_1", "frequency": "shuffle_distance"}


def criteria_table(spark: SparkSession, criteria: list[tuple[float, float]]) -> DataFrame:
    """(error_margin, proportion_of_runs)."""
    return spark.createDataFrame([(float(a), float(b)) for a, b in criteria], "error_margin double, proportion_of_runs double")


def estimable_sets(raw: DataFrame, criteria: DataFrame, metric: str = "relative_error_1", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """num_estimable_sets per method, scenario and criterion: the largest n such that for every n' from 2 to
    n the share of runs with an error strictly inside the margin reaches the proportion; 0 if none.

    The criteria are a handful of literals, so each result row is tested against all in one pass.
    """
    rows = criteria.collect()
    tests = F.array(*[F.struct(F.lit(r.error_margin).alias("error_margin"), F.lit(r.proportion_of_runs).alias("proportion_of_runs")) for r in rows])
    tested = raw.select(*keys, "num_sets", F.col(metric).alias("e"), F.explode(tests).alias("c"))
    crit = ["error_margin", "proportion_of_runs"]
    tested = tested.select(*keys, "num_sets", "c.*", F.coalesce((F.abs("e") < F.col("c.error_margin")) & ~F.isnan("e"), F.lit(False)).cast("int").alias("good"))
    shares = tested.groupBy(*keys, *crit, "num_sets").agg(F.avg("good").alias("share")).withColumn("ok", (F.col("num_sets") <= 1) | (F.col("share") >= F.col("proportion_of_runs")))
    failed = F.min(F.when(~F.col("ok"), F.col("num_sets")))
    firsts = shares.withColumn("first_failure", failed.over(Window.partitionBy(*keys, *crit)))
    good = (F.col("num_sets") > 1) & (F.col("first_failure").isNull() | (F.col("num_sets") < F.col("first_failure")))
    return firsts.groupBy(*crit, *keys).agg(F.coalesce(F.max(F.when(good, F.col("num_sets"))), F.lit(0)).cast("int").alias("num_estimable_sets"))


def error_at_estimable(raw: DataFrame, estimable: DataFrame, metric: str = "relative_error_1", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """estimable with the mean and standard deviation of the metric at that many sets; null where none."""
    of = raw.select(*keys, F.col("num_sets").alias("num_estimable_sets"), F.col(metric).alias("e"))
    both = estimable.join(of, [*keys, "num_estimable_sets"], "left")
    crit = ["error_margin", "proportion_of_runs"]
    return both.groupBy(*crit, *keys, "num_estimable_sets").agg(F.avg("e").alias(f"{metric}_mean"), F.stddev_samp("e").alias(f"{metric}_std"))


def long_frequencies(raw: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(…, run_index, num_sets, cardinality, source, frequency_level): a row per metric and level."""
    wide = [c for c in raw.columns if c.startswith(("estimated_cardinality_", "true_cardinality_"))]
    ids = [*keys, "run_index", "num_sets"]
    doubles = raw.select(*ids, *[F.col(c).cast("double").alias(c) for c in wide])
    long = doubles.unpivot(ids, wide, "variable", "cardinality")
    parts = F.regexp_extract("variable", r"^(.*)_(\d+)$", 1), F.regexp_extract("variable", r"^(.*)_(\d+)$", 2).cast("int")
    return long.select(*ids, "cardinality", parts[0].alias("source"), parts[1].alias("frequency_level"))


def per_frequency(long: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Exactly-k cardinalities from k-or-more ones; the last level stays."""
    order = Window.partitionBy(*keys, "run_index", "num_sets", "source").orderBy("frequency_level")
    return long.withColumn("cardinality", F.col("cardinality") - F.coalesce(F.lead("cardinality").over(order), F.lit(0.0)))


def at_estimable(long: DataFrame, estimable: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The rows of long at each criterion's number of estimable sets."""
    return long.join(estimable.withColumnRenamed("num_estimable_sets", "num_sets"), [*keys, "num_sets"])


def at_most_sets(long: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The rows of long at the largest num_sets."""
    top = F.max("num_sets").over(Window.partitionBy(*keys))
    return long.withColumn("_top", top).where("num_sets = _top").drop("_top")


def box_plot(raw: DataFrame, metric: str = "relative_error_1", limit: float | None = 0.1, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The five numbers of a box plot of the metric by num_sets, cut at +-limit."""
    missing = [c for c in ("num_sets", metric) if c not in raw.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    v = F.col(metric) if limit is None else F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col(metric)))
    five = raw.groupBy(*keys, "num_sets").agg(F.percentile(v, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("p"))
    return five.select(*keys, "num_sets", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def bar_plot(long: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Mean cardinality by level and source."""
    return long.groupBy(*keys, "frequency_level", "source").agg(F.avg("cardinality").alias("cardinality"))


def least_epsilon(raw: DataFrame, margin: float, proportion: float, by: tuple[str, ...]) -> DataFrame:
    """Per configuration the least epsilon whose runs meet the criterion, with their population deviation."""
    each = raw.groupBy(*by, "estimate_epsilon").agg(F.avg((F.abs("relative_error_1") < margin).cast("int")).alias("share"), F.stddev_pop("relative_error_1").alias("std"))
    return each.where(F.col("share") >= proportion).groupBy(*by).agg(F.min("estimate_epsilon").alias("least_epsilon"), F.min_by("std", "estimate_epsilon").alias("std"))


def summary(spark: SparkSession, raw: DataFrame, criteria: list[tuple[float, float]], kind: str = "cardinality") -> DataFrame:
    metric = METRICS[kind]
    found = estimable_sets(raw, criteria_table(spark, criteria), metric)
    return error_at_estimable(raw, found, metric)


def read_summary(spark: SparkSession, path: str, metric: str = "relative_error_1") -> DataFrame:
    """A summary written as CSV, with its schema stated."""
    columns = ["error_margin double", "proportion_of_runs double", *[f"{k} string" for k in KEYS], "num_estimable_sets int", f"{metric}_mean double", f"{metric}_std double"]
    return spark.read.csv(path, header=True, schema=", ".join(columns))
