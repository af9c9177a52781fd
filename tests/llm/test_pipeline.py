"""The pipeline's stages in a row, each against what it promises, and the registered oracles."""

import os

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import common, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
TABLES = "documents labels pages".split()


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if k + 1 == len(corpus_pipeline.STAGES):
            found = out.collect()
            assert {r["doc_id"] for r in found} == before
            used = {}
            for r in found:
                used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
            assert max(used.values()) <= 1024
            continue
        assert out.columns == docs.columns
        docs = common.as_table(out)
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after < before and after
        if k == 0:
            # nearly all of what the labels call good stays, and nearly all else goes (measured: 74 of 76, and 11 of 11)
            good, bad = ([i for i in before if labels.get(i) == q] for q in (1, 0))
            assert sum(i in after for i in good) >= 0.95 * len(good) and sum(i in after for i in bad) <= 0.05 * len(bad)
        before = after


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    rows = con.sql(queries.ORACLES[name])
    at = [rows.columns.index(c) for c in columns]
    assert mine == sorted(str(tuple(r[i] for i in at)) for r in rows.fetchall())
