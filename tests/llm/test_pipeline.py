import os

import pytest

import corpus_pipeline
from tallyspark.llm import queries
from tallyspark.llm.shared import materialize
from tests.llm.conftest import PASSAGE, prose
from tests.llm.test_others import toxic_data

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    data, labels = toxic_data()
    more = spark.createDataFrame([(10_000 + i, t, "en", "s9", len(t)) for i, t in data], docs.schema)
    docs.unionAll(more).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(10_000 + i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, prose(5, 40))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, docs, folder):
    at, sizes = spark.read.parquet(f"{folder}/documents.parquet"), []
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = materialize(stage(spark, at, folder), name)
        seen[name] = (ids(before), ids(at))
        if name != "source_mixing":
            assert at.columns == docs.columns
        sizes.append(at.count())
    data, labels = toxic_data()
    toxic = {10_000 + i for i, _, t in labels if t}
    gone = seen["toxicity"][0] - seen["toxicity"][1]
    assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 3
    assert seen["line_dedup"][0] == seen["line_dedup"][1]
    left = seen["ngram_jaccard_join"][1]
    assert {3, 11} <= left and not {20, 21, 22} & left
    lost = seen["benchmark_decontamination"][0] - seen["benchmark_decontamination"][1]
    assert {40, 41, 42, 43} & seen["benchmark_decontamination"][0] <= lost and 0 not in lost
    assert sizes[3] == sizes[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == seen["source_mixing"][1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.columns and df.count() >= 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = queries.queries()[name](spark, DATA)
    assert sorted(columns) == sorted(df.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()) == want
