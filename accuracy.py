"""How many sets can be estimated, and how far off: the published methods on the published scenarios' sizes.

Prints a JSON line for each method and scenario. ACCURACY_RUNS (default 20), ACCURACY_CPUS (default 8) and
ACCURACY_METHODS (names' beginnings, comma-joined; default all but the noised filter of 3e6 registers).
"""

from __future__ import annotations

import json
import os
import tempfile
from math import log

from pyspark.sql import SparkSession, functions as F

from tallyspark.operators import sketches as sk
from tallyspark.plans import analyze, evaluate, methods as m, registry
from tallyspark.sources import generators as gen

RUNS = int(os.environ.get("ACCURACY_RUNS", "20"))
CPUS = os.environ.get("ACCURACY_CPUS", "8")
#: Error margin and share of runs within it.
CRITERIA = [(0.2, 0.8), (0.1, 0.95), (0.05, 0.95)]
SETS = 20


def scenarios() -> list[registry.Scenario]:
    return [
        registry.Scenario("independent", gen.Independent(200_000, [20_000] * SETS)),
        registry.Scenario("remarketing", gen.Independent(40_000, [20_000] * SETS)),
        registry.Scenario("fully_overlapping", gen.FullyOverlapping(200_000, SETS, 20_000)),
        registry.Scenario("sequentially_correlated_all", gen.SequentiallyCorrelated("original", "all", 0.5, [10_000] * SETS)),
        registry.Scenario("sequentially_correlated_one", gen.SequentiallyCorrelated("original", "one", 0.5, [10_000] * SETS)),
    ]


def geo_filter(length: int, local: float | None) -> m.Method:
    """Probability 0.0012, that of an older description; the published results don't record theirs, but their spread fits it and not the registry's 2 / length."""
    return registry.method("geo_bloom_filter", f"{length}_0.001200", "first_moment_geo", m.filter_method(sk.geometric_filter(length, 0.0012), local), local=local)


def methods() -> list[m.Method]:
    made = [make(length, local) for make, length in ((registry.exp_filter, 100_000), (registry.log_filter, 100_000), (registry.voc, 4096), (geo_filter, 10_000), (registry.uniform_filter, 3_000_000)) for local in (None, log(3))]
    asked = os.environ.get("ACCURACY_METHODS")
    return [x for x in made if x.name.startswith(tuple(asked.split(",")))] if asked else made[:-1]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("accuracy")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    criteria = analyze.criteria_table(spark, CRITERIA)
    for scenario in scenarios():
        with tempfile.TemporaryDirectory() as out:
            evaluate.evaluate(spark, registry.Evaluation("published", RUNS, (scenario,)), methods(), out, overwrite=True)
            raw = evaluate.read_results(spark, out).cache()
            sets = analyze.estimable_sets(raw, criteria).collect()
            last = raw.where(F.col("num_sets") == SETS).groupBy("sketch_estimator").agg(F.avg("relative_error_1").alias("mean"), F.stddev_samp("relative_error_1").alias("std"), F.avg("true_cardinality_1").alias("truth")).collect()
            for r in sorted(last):
                at = {f"{c.proportion_of_runs:.0%}/{c.error_margin:.0%}": c.num_estimable_sets for c in sets if c.sketch_estimator == r.sketch_estimator}
                print(json.dumps({"scenario": scenario.name, "method": r.sketch_estimator, "runs": RUNS, "estimable_sets": at, "error_mean": r["mean"], "error_std": r.std, "true_reach": r.truth}), flush=True)
            raw.unpersist()
    spark.stop()


if __name__ == "__main__":
    main()
