from pyspark.sql import functions as F

from tallyspark.operators import sketches as sk
from tallyspark.streaming import incremental


def test_incremental_reach_equals_batch(spark, tmp_path):
    rows = spark.range(2000).select(F.lit(0).alias("run_index"), (F.col("id") % 2 + 1).cast("int").alias("set_index"), (F.col("id") % 700).alias("id"), F.timestamp_seconds(F.col("id") * 7).alias("ts"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sketch = sk.uniform_filter(5000)
    q = incremental.register_stream(stream, sketch, late="10 days").writeStream.outputMode("complete").format("memory").queryName("registers").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = incremental.window_reach(spark.table("registers"), sketch).collect()
    assert len(got) == 2 * len({r.start for r in got})
    for r in got:
        ids = rows.where((F.col("ts") >= F.lit(r.start)) & (F.col("ts") < F.lit(r.start) + F.expr("interval 1 hour")) & (F.col("set_index") <= r.num_sets)).select("id").distinct().count()
        assert abs(r.estimate - ids) <= max(3, 0.05 * ids)
