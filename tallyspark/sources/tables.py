"""Impressions and results from tables: column mappings over Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def impressions(df: DataFrame, set_index: Column, user_id: Column, run_index: Column | None = None) -> DataFrame:
    """(run_index, set_index, id) from any table; rows without a set or an id are no impressions."""
    rows = df.select((F.lit(0) if run_index is None else run_index).cast("int").alias("run_index"), set_index.cast("int").alias("set_index"), user_id.cast("long").alias("id"))
    return rows.where("set_index is not null and id is not null")


def order_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers reached by each order priority: five overlapping sets."""
    return impressions(read(spark, sf_dir, "orders"), F.substring("o_orderpriority", 1, 1), F.col("o_custkey"))


def event_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users reached by each type of event, in the types' order: nearly the same users everywhere."""
    events = read(spark, sf_dir, "events").select("event_type", "user_id").where("event_type is not null")
    types = events.select("event_type").distinct()
    # one row a set
    types = types.withColumn("number", F.row_number().over(Window.orderBy("event_type")))
    return impressions(events.join(types, "event_type"), F.col("number"), F.col("user_id"))


def read_csv_results(spark: SparkSession, path: str, max_frequency: int) -> DataFrame:
    """Raw results written as CSV, with their schema stated rather than inferred."""
    ks = range(1, max_frequency + 1)
    columns = ["num_sets int", *[f"estimated_cardinality_{k} double" for k in ks], *[f"true_cardinality_{k} double" for k in ks], "shuffle_distance double", "run_index int", *[f"relative_error_{k} double" for k in ks]]
    return spark.read.csv(path, header=True, schema=", ".join(columns))


def write_csv_results(raw: DataFrame, path: str) -> None:
    raw.write.mode("overwrite").csv(path, header=True)
