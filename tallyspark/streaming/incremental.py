"""Incremental reach over a stream of impressions (an extension: the batch evaluations have no streams).

Register tables are mergeable, so a windowed stateful aggregation keeps one row per
window, set and register; estimates of closed windows are a batch query over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyspark.operators import estimators as est, prefixes
from tallyspark.operators.sketches import AnySketch


def register_stream(impressions: DataFrame, sketch: AnySketch, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, run_index, set_index, register, value) of tumbling windows from a stream of
    (run_index, set_index, id, time); rows later than the watermark are dropped by it."""
    placed = sketch.placed(impressions.withWatermark(time, late))
    rows = placed.groupBy(F.window(time, window).alias("w"), "run_index", "set_index", "register").agg(F.lit(1.0).alias("value"))
    return rows.select(F.col("w.start").alias("start"), "run_index", "set_index", "register", "value")


def window_reach(registers: DataFrame, sketch: AnySketch) -> DataFrame:
    """(start, num_sets, estimate) of stored registers, each window taken as a run of its own."""
    keyed = registers.withColumn("run_index", F.unix_timestamp("start"))
    found = est.filter_prefixes(keyed, prefixes.set_grid(keyed), sketch)
    return found.select(F.timestamp_seconds("run_index").alias("start"), "num_sets", "estimate")
