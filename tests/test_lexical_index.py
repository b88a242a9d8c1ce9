import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import lexical
from corvane.operators import lexical_index as L


def corpus(n, seed, first=0):
    """Texts whose words follow a steep law, so that some are in nearly all texts."""
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(2000)]
    weights = [1 / (i + 1) for i in range(2000)]
    return [(first + i, " ".join(rng.choices(names, weights, k=rng.choice([3, 20, 60, 200])))) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))


def check(spark, docs, queries, k, path, index=None):
    index = index or L.Index(spark, path)
    hits, counters = L.search(index, queries, k)
    assert rows(hits) == rows(lexical.bm25_topk(docs, queries, k))
    return counters


@pytest.fixture
def queries(spark):
    texts = [(q, t) for q, (_, t) in enumerate(corpus(40, 9))] + [(100, "w0 w0 w1"), (101, "nothing here"), (102, None), (103, "w1999 w0"), (104, "")]
    return spark.createDataFrame(texts, "query_id long, query string")


@pytest.mark.parametrize("block", [1024, 16])
def test_same_rows_as_all_scores(spark, tmp_path, monkeypatch, queries, block):
    monkeypatch.setattr(L, "BLOCK", block)
    docs = spark.createDataFrame([*corpus(900, 1), (5000, None), (5001, ""), (None, "w5 w7"), (None, "w5 w7"), (7, "w0 w0 w3"), (7, "w0 w0 w3")], "doc_id long, text string")
    single = docs.filter("doc_id is not null and (doc_id <> 7 or text <> 'w0 w0 w3')")
    L.build(single, str(tmp_path / "single"))
    check(spark, single, queries, 7, str(tmp_path / "single"))
    L.build(docs, str(tmp_path / "index"))  # rows that repeat an id are documents of their own; null ids come last among equals
    hits, _ = L.search(L.Index(spark, str(tmp_path / "index")), spark.createDataFrame([(1, "w7 w5"), (2, "w3 w0 w0")], "query_id long, query string"), 300)
    got = hits.orderBy("query_id", "rank").collect()
    assert [r.id for r in got if r.query_id == 1].count(None) == 2 and [r.id for r in got if r.query_id == 2].count(7) >= 2
    assert all(x.score > y.score or (x.score == y.score and (y.id is None or (x.id is not None and x.id <= y.id))) for x, y in zip(got, got[1:]) if x.query_id == y.query_id)


def test_few_postings_of_common_words_are_scored(spark, tmp_path):
    """Queries are passages that some texts hold, as in search: then common words are hardly scored."""
    rng = random.Random(4)
    made = corpus(6000, 2)
    passages = [" ".join(f"p{q}x{i}" if i % 3 == 0 else f"w{rng.randint(0, 30)}" for i in range(24)) for q in range(20)]
    made = [(i, t + " " + passages[i % 20] if i % 7 == 0 else t) for i, t in made]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "query_id long, query string")
    L.build(docs, str(tmp_path / "index"))
    counters = check(spark, docs, asked, 10, str(tmp_path / "index"))
    got = counters.agg(F.sum("common_postings"), F.sum("common_scored"), F.sum("postings"), F.sum("scored")).first()
    assert 0 < got[1] < got[0] / 3 and got[3] < got[2] / 3


def test_appending_leaves_old_blocks_alone(spark, tmp_path, queries):
    path = tmp_path / "index"
    one, two = (spark.createDataFrame(corpus(300, s, s * 1000), "doc_id long, text string") for s in (1, 2))
    L.build(one, str(path))
    before = {p: p.stat().st_mtime_ns for p in path.rglob("part-*")}
    L.build(two, str(path))
    after = {p: p.stat().st_mtime_ns for p in path.rglob("part-*")}
    assert len(after) > len(before) and all(after[p] == t for p, t in before.items())
    check(spark, one.union(two), queries, 6, str(path))


def test_only_the_buckets_of_the_words_are_read(spark, tmp_path):
    L.build(spark.createDataFrame(corpus(200, 3), "doc_id long, text string"), str(tmp_path / "index"))
    index = L.Index(spark, str(tmp_path / "index"))
    wanted = spark.createDataFrame([("w0",)], "token string")
    assert len({f.split("bucket=")[1].split("/")[0] for f in index.heads(wanted).inputFiles()}) == 1 or "PartitionFilters: [isnotnull(bucket" in index.heads(wanted)._jdf.queryExecution().toString() or "PartitionFilters: [(bucket" in index.heads(wanted)._jdf.queryExecution().toString()


def test_queries_in_slices_and_empty_tables(spark, tmp_path, monkeypatch, queries):
    docs = spark.createDataFrame(corpus(200, 5), "doc_id long, text string")
    L.build(docs, str(tmp_path / "index"))
    monkeypatch.setattr(L, "BROADCAST_TERMS", 1000)
    check(spark, docs, queries, 4, str(tmp_path / "index"))
    hits, counters = L.search(L.Index(spark, str(tmp_path / "index")), queries.limit(0), 4)
    assert hits.count() == counters.count() == 0
    L.build(docs.limit(0), str(tmp_path / "none"))
    hits, counters = L.search(L.Index(spark, str(tmp_path / "none")), queries, 4)
    assert hits.count() == counters.count() == 0
