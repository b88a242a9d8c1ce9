import os

import pytest
from oracle import compare

import corvane.plans.catalogue_more  # noqa: F401
from corvane.plans.catalogue import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@there
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], FOLDER)


@there
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


@there
@pytest.mark.parametrize("name", ["metrics_by_k", "rerank_embedding"])
def test_every_row_is_a_query(spark, name):
    ids = {r.vec_id for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    rows = QUERIES[name](spark, FOLDER).collect()
    assert {r.n for r in rows} == {len(ids)} if name == "metrics_by_k" else {r.query_id for r in rows} == ids


def test_entry_is_importable():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
