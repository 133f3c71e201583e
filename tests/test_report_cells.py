"""The report's cells against DuckDB's: signs of small numbers, halves, and methods that a scenario lacks."""

import duckdb
import pytest

from tallyspark.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines"))
    errors = {("A", "F"): -0.00003, ("A", "O"): 0.00003, ("N", "O"): -3e-7, ("R", "F"): 0.00015, ("R", "O"): -0.00015}
    rows = [(flag, status, run, n, 0.05 + e, 1.0, 0.1) for (flag, status), e in errors.items() for run in (0, 1) for n in (1, 2)]
    columns = "l_returnflag string, l_linestatus string, l_orderkey long, l_linenumber int, l_discount double, l_quantity double, l_tax double"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("name", ["pivoted_report", "error_at_estimable"])
def test_signs_and_halves(spark, lines, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{lines}/lineitem.parquet/*.parquet')")
    df = QUERIES[name](spark, lines)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()
    found = sorted(repr(tuple(r)) for r in df.collect())
    assert found == sorted(map(repr, want))
    if name == "pivoted_report":
        assert any("-0.0000" in r for r in found) and any("2 (0.0001, " in r for r in found)
