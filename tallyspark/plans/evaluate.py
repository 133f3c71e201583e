"""Evaluation: scenarios times methods, written as one table.

A scenario's impressions are made and written once; its methods then run side by side on them, as separate
Spark jobs from a few driver threads, so that one method's last tasks don't hold up the next.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.functions.hashing import h60_value
from tallyspark.plans.methods import Method
from tallyspark.plans.registry import Evaluation
from tallyspark.plans.simulate import raw_results, sketch_seed_of

LABELS = ("sketch", "sketch_config", "estimator", "sketch_epsilon", "estimate_epsilon")
LABEL_TYPES = {"sketch_epsilon": "double", "estimate_epsilon": "double"}


def with_labels(raw: DataFrame, method: Method, scenario: str) -> DataFrame:
    """Results with their method, its parameters, and their scenario as columns."""
    return raw.withColumns({k: F.lit(method.parts.get(k)).cast(LABEL_TYPES.get(k, "string")) for k in LABELS} | {"sketch_estimator": F.lit(method.name), "scenario": F.lit(scenario)})


def evaluate(spark: SparkSession, evaluation: Evaluation, methods: list[Method], out: str, *, max_frequency: int = 1, seed: int = 1, overwrite: bool = False, file_format: str = "parquet", workers: int = 4) -> DataFrame:
    """Run all pairs and return their running times (sketch_estimator, scenario, running_time in hours).

    Results go to `out`/raw, a folder for each pair; the same scenario's data come from the
    same seed for every method. An existing folder is an error unless overwrite is set. `workers` methods run at a time.
    """
    names = [(s.name, m.name) for s in evaluation.scenarios for m in methods]
    if len(set(names)) < len(names):
        raise ValueError("methods and scenarios have different names")
    # the first write decides whether the folder may be replaced
    spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "pair int, scenario string, sketch_estimator string").write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{out}/raw")
    times = []
    for at, scenario in enumerate(evaluation.scenarios):
        impressions = f"{out}/impressions/scenario={at}"
        scenario.generator.generate(spark, evaluation.num_runs, h60_value(seed, scenario.name) % (1 << 31)).write.mode("overwrite").parquet(impressions)
        data = spark.read.schema("run_index int, set_index int, id long").parquet(impressions)

        def run(numbered: tuple[int, Method]) -> tuple[str, str, float]:
            i, method = numbered
            began = time.time()
            raw = with_labels(raw_results(data, method, sketch_seed_of(seed), max_frequency), method, scenario.name)
            writer = raw.write.mode("overwrite")
            (writer.option("header", True) if file_format == "csv" else writer).format(file_format).save(f"{out}/results/pair={at * len(methods) + i}")
            return method.name, scenario.name, (time.time() - began) / 3600

        with ThreadPoolExecutor(max(1, workers)) as pool:
            times += pool.map(run, enumerate(methods))
    made = spark.createDataFrame(times, "sketch_estimator string, scenario string, running_time double")
    made.write.mode("overwrite").parquet(f"{out}/times")
    raw = read_results(spark, out, file_format)
    raw.groupBy("sketch_estimator", "scenario", "num_sets").agg(*[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in raw.columns if c.startswith(("estimated_", "true_", "relative_")) for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]).write.mode("overwrite").parquet(f"{out}/aggregated")
    return made


def read_results(spark: SparkSession, out: str, file_format: str = "parquet") -> DataFrame:
    """All pairs' results. Text columns get the types that the results' names state, without another scan to guess them."""
    reader = spark.read.format(file_format)
    raw = (reader.option("header", True) if file_format == "csv" else reader).load(f"{out}/results").drop("pair")
    if file_format != "csv":
        return raw
    kinds = {c: "string" for c in (*LABELS, "sketch_estimator", "scenario")} | LABEL_TYPES | {"run_index": "int", "num_sets": "int"}
    return raw.select(*[F.col(c).cast(kinds.get(c, "long" if c.startswith("true_") else "double")).alias(c) for c in raw.columns])


def running_times(times: DataFrame) -> DataFrame:
    """Hours per method over all scenarios, by name."""
    return times.groupBy("sketch_estimator").agg(F.sum("running_time").alias("running_time")).orderBy("sketch_estimator")
