"""Membership of every id, by brute force on a small table whose ids go beyond 500."""

from collections import defaultdict

from tallyspark.queries import K3, QUERIES
from tallyspark.sources import tables


def test_bloom_membership(spark, tmp_path):
    data = [(f"{1 + i % 5}-X", 400 + 7 * i) for i in range(150)]
    spark.createDataFrame(data, "o_orderpriority string, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    imps = tables.order_impressions(spark, str(tmp_path))
    registers, bits = defaultdict(set), defaultdict(set)
    for r in K3.placed(imps.select("id").distinct()).collect():
        registers[r.id].add(r[K3.axes[0]])
    for r in imps.collect():
        bits[r.set_index] |= registers[r.id]
    want = sorted((s, i) for s in bits for i in registers if registers[i] <= bits[s])
    got = sorted((r.set_index, r.id) for r in QUERIES["bloom_membership"](spark, str(tmp_path)).collect())
    assert got == want and max(i for _, i in got) == 400 + 7 * 149
