"""The pipeline on the small tables, and the registered SQL."""

import duckdb
import pytest

from rivulet.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want.select(*columns).fetchall()))


def test_pipeline(spark):
    import corpus_pipeline

    docs = corpus_pipeline.documents(spark, SF)
    rows, texts = docs.count(), docs.select("text").distinct().count()
    out = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, out = out.count(), corpus_pipeline.materialise(stage(spark, out, SF), name)
        assert out.columns == docs.columns and out.count() <= before
        if name == "exact_dedup":
            assert out.count() == texts
    assert 0 < out.count() < rows
    packed = corpus_pipeline.pack_sequences(spark, out, SF)
    assert packed.select("doc_id").distinct().count() == out.count()
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
