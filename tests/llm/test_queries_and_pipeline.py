import os

import pytest
from helpers import empty, messy
from oracle import compare
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from corvane.llm.queries import QUERIES, SQL
from corvane.llm.simhash import near_duplicates

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


def test_operators_are_numbered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@there
def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, seen[-1], FOLDER).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if k < 4:
            assert seen[-1].columns == docs.columns and seen[-1].count() <= seen[-2].count() * (2 if name == "mix" else 1)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = labels.join(seen[1], "doc_id", "left_semi")
    good = labels.filter("quality = 1")
    assert kept.filter("quality = 1").count() >= 0.97 * good.count()
    assert near_duplicates(seen[2]).filter("doc_id <> group_id").count() == seen[2].count() - seen[3].count()
    assert near_duplicates(seen[3]).filter("doc_id <> group_id").count() == 0  # one document of each group is left
    assert seen[5].filter("not round_trip").count() == 0 and seen[5].count() == seen[4].count()
    again = pipeline.run(spark, FOLDER)
    key = lambda d: sorted(map(tuple, d.select("doc_id", "n_tokens").collect()))
    assert key(again) == key(seen[5])


def folder(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (8, 0), (12, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("table", [messy, empty])
def test_stages_take_messy_tables(spark, tmp_path, table):
    where = folder(spark, tmp_path, table(spark))
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, where)
        assert name == "tokens" or out.columns == docs.columns
        if table is empty:
            assert out.count() == 0
        else:
            out.write.mode("overwrite").parquet(str(tmp_path / name))
            if name != "quality":
                docs = spark.read.parquet(str(tmp_path / name))


def test_near_copies_leave_one(spark):
    words = [f"w{i}" for i in range(900)]
    near = list(words)
    near[450] = "other"
    docs = spark.createDataFrame([(3, " ".join(words), "en", "s", 1), (2, " ".join(near), "en", "s", 1), (9, "quite another text here", "en", "s", 1), (None, " ".join(words), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in pipeline.simhash_stage(spark, docs, "").collect()} == {2, 9, None}


def test_mix_repeats_documents(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", "s", 5) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.mix_stage(spark, docs, "")
    assert out.count() == 60 and out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_near_copies_go_by_row(spark):
    text = lambda name, odd=None: " ".join("odd" if i == odd else f"{name}{i}" for i in range(300))
    rows = [(1, text("a")), (5, text("a", 150)), (5, text("b")), (5, text("c")), (6, text("b", 40)), (7, text("d")), (7, text("d")), (8, text("d", 9)), (9, text("e")), (None, text("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in pipeline.simhash_stage(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, text("a")), (5, text("b")), (5, text("c")), (7, text("d")), (9, text("e")), (None, text("f"))], key=repr)
