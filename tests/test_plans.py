import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corvane.operators import answers, evaluation
from corvane.plans import evaluate, ingest, rag
from corvane.sources import collections

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([(1, "The red fox lives in the forest near Hanoi. It hunts at night."), (2, "Stock prices rose by 5% in March. Traders were glad about it."), (3, "The university raised its fees in 2024. Students were told in May.")], "doc_id long, text string")
    cases = spark.createDataFrame([(1, "Where does the red fox live?", "The red fox lives in the forest near Hanoi"), (2, "How much did stock prices rise?", "Stock prices rose by 5% in March")], "query_id long, question string, truth string")
    qrels = spark.createDataFrame([(1, 1), (2, 2)], "query_id long, id long")
    return docs, cases, qrels


def test_evaluation_of_methods(corpus):
    docs, cases, qrels = corpus
    got = {(r.method, r.k): r for r in evaluate.evaluate_retrieval(docs, cases, qrels, (1, 3)).collect()}
    assert got["bm25", 1].precision == 1.0 and got["hybrid", 1].rr == 1.0 and set(m for m, _ in got) == {"vector", "bm25", "hybrid"}


def test_end_to_end(corpus):
    docs, cases, qrels = corpus
    r = evaluate.end_to_end(docs, cases, qrels).first()
    assert r.mrr == 1.0 and r.f1 > 0.4 and 0 < r.score <= 1


class Echo:
    def answer(self, prompt):
        if "stock" in prompt.lower().split("question:")[1]:
            raise RuntimeError("down")
        return "The red fox lives in the forest near Hanoi city."


def test_generator_provider(corpus):
    docs, cases, _ = corpus
    got = {r.query_id: r for r in rag.answer(docs, cases, least=0.0, generator=Echo()).collect()}
    assert got[1].n_grounded == 1 and got[2].answer == "Error: down"


def test_retrieve_and_compress(corpus):
    docs, cases, _ = corpus
    got = rag.retrieve_and_compress(docs, cases, 1).collect()
    assert {(r.query_id, r.id) for r in got} == {(1, 1), (2, 2)}


def test_contexts_and_sources(spark):
    hits = spark.createDataFrame([(1, 7, "b", 0.5, 2, None, None), (1, 8, "a", 0.9, 1, 0.0, 61.5)], "query_id long, id long, text string, score double, rank int, s double, e double").withColumn("f", F.lit("x.mp3"))
    assert answers.format_context(hits, start="s", end="e", file="f").first().context == "1. [x.mp3:00:00:00.00-00:01:01.50]\na\n\n2. b\n"
    assert [s.id for s in answers.format_sources(hits).first().sources] == [8, 7]


def test_random_search_and_accuracy(spark):
    grid = {"a": [1, 2, 3], "b": [4, 5]}
    x = [tuple(r) for r in evaluation.random_configurations(spark, grid, 4, 7).collect()]
    assert len(set(x)) == 4 and x == [tuple(r) for r in evaluation.random_configurations(spark, grid, 4, 7).collect()]
    c = evaluation.grounding_confusion(spark.createDataFrame([("A", "a"), ("B", "a")], "expected string, actual string"))
    assert evaluation.accuracy(c).first().accuracy == 0.5


def test_ingest_is_repeatable(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    (src / "a.txt").write_text("First sentence here. Second sentence there.")
    (src / "b.txt").write_text("First sentence here. Second sentence there.")
    (src / "c.docx").write_bytes(b"broken")
    (src / "d.zzz").write_text("?")
    first = ingest.add_folder(spark, str(src), store, tags=["x"])
    assert {(r.file_type, r.status, r.chunk_count) for r in first["registry"].collect()} == {("txt", "processed", 1), ("docx", "failed", 0)}
    assert first["duplicates"].count() == 1 and first["rejected"].count() == 1
    (src / "e.md").write_text("# New text\n\nwith words.")
    second = ingest.add_folder(spark, str(src), store)
    assert second["registry"].count() == 3
    points = ingest.rebuild(spark, store, str(tmp_path / "anew"))
    assert points.count() == 2 and collections.collection_stats(points).first().dimensions == 64


def test_collections(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "t", {"k": "v"}, [1.0, 2.0])], "doc_id long, chunk_index int, text string, meta map<string,string>, embedding array<double>").withColumn("at", F.lit("2024-01-01").cast("date"))
    for _ in range(2):
        collections.append_points(df, str(tmp_path / "c"))
    p = collections.collection(spark, str(tmp_path / "c"))
    r = p.first()
    assert p.count() == 1 and r.meta == '{"k":"v"}' and r["at"] == "2024-01-01" and collections.get_point(p, r.point_id).count() == 1
    assert collections.update_payload(p, [r.point_id], {"text": "new", "flag": True}).first().text == "new"
    collections.create_collection(spark, "corvane_test_points", "point_id string, embedding array<double>")
    assert spark.table("corvane_test_points").count() == 0
    collections.drop_collection(spark, "corvane_test_points")
