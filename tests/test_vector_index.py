import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import search
from corvane.operators import vector_index as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def made(n, width, seed, spread=0.6):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((12, width))
    which = rng.integers(0, 12, n)
    x = (centre[which] + spread * rng.standard_normal((n, width))).astype(np.float32)
    return [(i, v.tolist(), int(w)) for i, (v, w) in enumerate(zip(x, which))]


def recall(found, exact):
    want = {(r.query_id, r.id) for r in exact.collect()}
    return len(want & {(r.query_id, r.id) for r in found.collect()}) / len(want)


def test_clustered_points_need_few_cells(spark, tmp_path):
    points = spark.createDataFrame(made(3000, 10, 1), SCHEMA)  # 10 components: the last piece is filled up
    V.build(points, str(tmp_path / "i"), payload=("label",))
    index = V.VectorIndex(spark, str(tmp_path / "i"))
    assert index.n == 3000 and index.codes.count() == 3000
    queries = points.filter("vec_id % 20 = 0")
    found = V.search(index, points, queries, 10, scan=0.15)
    assert recall(found, search.knn(points, queries, 10)) >= 0.9
    got = found.agg(F.max("compared"), F.avg("scanned")).first()
    assert got[0] <= 300 and got[1] <= 0.3 * 3000
    exact = {(r.query_id, r.id): r.score for r in search.knn(points, queries, 10).collect()}
    assert all(abs(exact[r.query_id, r.id] - r.score) < 2e-6 for r in found.collect() if (r.query_id, r.id) in exact)


def test_filters_reach_the_codes(spark, tmp_path):
    points = spark.createDataFrame(made(1500, 8, 2), SCHEMA)
    V.build(points, str(tmp_path / "i"), payload=("label",))
    index = V.VectorIndex(spark, str(tmp_path / "i"))
    queries = points.filter("vec_id % 50 = 0")
    found = V.search(index, points, queries, 5, scan=1.0, conditions={"label": {"gte": 3, "lte": 4}}, threshold=0.2)
    kept = points.filter("label between 3 and 4")
    assert recall(found, search.knn(kept, queries, 5, threshold=0.2)) >= 0.9
    assert found.filter("score < 0.2").count() == 0 and found.join(kept, F.col("id") == F.col("vec_id"), "left_anti").count() == 0


def test_only_probed_cells_are_read(spark, tmp_path):
    points = spark.createDataFrame(made(800, 8, 3), SCHEMA)
    V.build(points, str(tmp_path / "i"), cells=20)
    index = V.VectorIndex(spark, str(tmp_path / "i"))
    plan = V.search(index, points, points.filter("vec_id = 5"), 3, scan=0.05)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_odd_tables(spark, tmp_path, monkeypatch):
    rows = [*made(60, 4, 4), (100, None, 1), (101, [0.0] * 4, 1), (None, [1.0, 0.0, 0.0, 0.0], 2), *[(7, [1.0, 2.0, 3.0, 4.0], 3)] * 30]
    points = spark.createDataFrame(rows, SCHEMA)
    V.build(points, str(tmp_path / "i"))
    index = V.VectorIndex(spark, str(tmp_path / "i"))
    assert index.n == 91
    monkeypatch.setattr(V, "BLOCK", 4)
    found = V.search(index, points, points.filter("vec_id < 10"), 3, scan=1.0)
    assert found.groupBy("query_id").count().filter("count > 3").count() == 0
    V.build(points.limit(0), str(tmp_path / "e"))
    assert V.search(V.VectorIndex(spark, str(tmp_path / "e")), points.limit(0), points, 3).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_query(spark, folder):
    from corvane.plans.catalogue import QUERIES

    r = QUERIES["vector_ann_recall"](spark, folder).first()
    assert r.recall >= 0.9 and r.compared <= 0.1 and r.scanned < 0.85
