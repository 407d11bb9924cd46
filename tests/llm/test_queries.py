"""Registered queries against their SQL, and the stages of the pipeline."""
import duckdb
import pytest

import corpus_pipeline
from chronotext.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    result = con.sql(queries.ORACLE_SQL[name])
    at = [result.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in result.fetchall())))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(ids) == before


def test_all_numbers_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))
