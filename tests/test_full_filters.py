"""Estimates of filters that are full, or nearly so, against DuckDB's results of the same SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import numerics
from tallyspark.operators import estimators as est, prefixes, sketches as sk
from tallyspark.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Orders of 400 customers in set 1, 20,000 in the first two and 160,000 in all three: the filters of 4,096 registers fill up."""
    path = str(tmp_path_factory.mktemp("many"))
    n = F.col("id")
    priority = F.when(n < 400, "1-URGENT").when(n < 20_000, "2-HIGH").otherwise("3-MEDIUM")
    spark.range(0, 160_000, 1, 4).select(priority.alias("o_orderpriority"), n.alias("o_custkey")).write.parquet(f"{path}/orders.parquet")
    return path


def both(spark, path, name):
    """(num_sets, estimate) of the query and of its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{path}/orders.parquet/*.parquet')")
    want = con.execute(f"SELECT num_sets, estimate FROM ({ORACLES[name]}) ORDER BY num_sets").fetchall()
    found = QUERIES[name](spark, path).orderBy("num_sets").select("num_sets", "estimate").collect()
    return [tuple(r) for r in found], want


def test_full_bloom_filter(spark, many):
    found, want = both(spark, many, "bloom_union_estimate")
    assert found == want and found[2][1] == float("inf")


def test_full_uniform_filter(spark, many):
    found, want = both(spark, many, "uniform_estimate")
    assert found == want and found[2][1] == float("inf")


def test_full_geometric_filter(spark, many):
    found, want = both(spark, many, "geometric_estimate")
    assert found == want and 160_000 < found[2][1] < 1e6


def test_weighted_filter(spark, many):
    found, want = both(spark, many, "weighted_estimate")
    assert found == want


def test_full_weighted_filter(spark):
    """Full from the first set on: the least n that fills it, whatever the order of the rows."""
    weights = np.linspace(0.5, 1.5, 1024)
    sketch = sk.logarithmic_filter(1024, seed=7)
    p = sketch.distributions[0].probabilities()
    registers = spark.range(2048).select(F.lit(0).alias("run_index"), (F.col("id") % 2 + 1).cast("int").alias("set_index"), F.floor(F.col("id") / 2).cast("int").alias("register"), F.lit(1.0).alias("value"))
    grid = prefixes.set_grid(registers)
    found = {est.weighted_prefixes(registers.orderBy(F.xxhash64("register", F.lit(n))).repartition(n), grid, sketch, weights).where("num_sets = 2").first()["estimate"] for n in (1, 3, 7)}
    assert len(found) == 1
    n = found.pop()
    assert n == pytest.approx(32310187.392, abs=1e-3)
    total = float(np.cumsum(weights)[-1])
    assert numerics.ordered_fill(n * 1.001, p, weights) == total > numerics.ordered_fill(n * 0.9, p, weights)


def test_halving_has_no_end():
    tiny = np.array([0.5, 1e-13])
    assert numerics.saturation(tiny) > 1e14
    assert numerics.invert_halving(lambda n: numerics.ordered_fill(n, tiny), np.array([0.0, 3.0])).tolist() == [0.0, np.inf]


def test_weights_of_one_are_registers(spark):
    """Without weights, and beyond any array of literals."""
    sketch = sk.logarithmic_filter(100_000, seed=7)
    registers = spark.range(300).select(F.lit(0).alias("run_index"), F.lit(1).alias("set_index"), F.col("id").cast("int").alias("register"))
    n = est.weighted_prefixes(registers, prefixes.set_grid(registers), sketch).first()["estimate"]
    assert numerics.ordered_fill(n, sketch.distributions[0].probabilities()) == pytest.approx(300)
