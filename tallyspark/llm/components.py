"""Connected components of an undirected graph, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.shared import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) for every end of an edge; label is the component's smallest id.

    Alternates the large-star and small-star steps of Kiveris et al. (2014):
    each step only groups the edges at one node to find its smallest
    neighbour, so a hub's edges are combined before they are shuffled. Stops when a
    round changes nothing. Edges with a null end are ignored; an empty input
    gives an empty table.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    current = materialize(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        # large star: neighbours greater than u go to the smallest of u's neighbourhood
        ends = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ends.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: neighbours not greater than u, and u, go to the smallest of them
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        current = materialize(small.where("u <> v").distinct(), "stars")
        after = current.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if after == before:
            break
        before = after
    roots = current.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label"))
    return roots.unionAll(current.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
