"""The stages on a small table, and the SQL of the registered queries."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tagloom.llm.queries import ORACLES, QUERIES


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, docs, sf))
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        assert 0 < out.count() <= 3 * docs.count()
        docs = out
    counts = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert counts.count() == docs.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_registered():
    names = set(entry.queries())
    assert {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert "pipeline" in names
