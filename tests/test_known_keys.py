import pytest
from pyspark.sql import functions as F

from corvane.operators import known_keys as K


@pytest.mark.parametrize("start", [1 << 16, 100])
def test_equal_to_the_plain_join_as_it_grows(spark, tmp_path, monkeypatch, start):
    monkeypatch.setattr(K, "LEAST_KEYS", start)
    path, known = str(tmp_path / "filter"), None
    for step in range(4):
        new = spark.range(step * 700, (step + 1) * 700).select(F.md5(F.col("id").cast("string")).alias("key"))
        K.add(spark, path, new, "key")
        known = new if known is None else known.unionByName(new)
        batch = spark.range(2000, 4200).select(F.md5(F.col("id").cast("string")).alias("key"), "id").unionByName(spark.createDataFrame([(None, 1), (None, 1), ("x", 2), ("x", 2)], "key string, id long"))
        got = K.unknown(batch, known, path, "key")
        assert got.columns == batch.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, batch.join(known, "key", "left_anti").select("key", "id").collect()), key=repr)
    generations = K.read(spark, path).select("generation", "room", "filled").distinct().orderBy("generation").collect()
    assert sum(g.filled for g in generations) == 2800 and all(g.filled <= g.room for g in generations)
    assert len(generations) == (1 if start > 2800 else 3) and all(y.room >= 2 * x.room for x, y in zip(generations, generations[1:]))


def test_few_rows_are_left_for_the_join(spark, tmp_path):
    path = str(tmp_path / "filter")
    known = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    K.add(spark, path, known, "key", rate=0.01)
    batch = spark.range(19_500, 29_500).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))  # 95 of 100 are new
    flagged = K.maybe_known(batch, path, "key")
    maybe = flagged.filter("__maybe").count()
    assert 500 <= maybe <= 650  # a tenth of the batch would be 1000
    assert K.unknown(batch, known, path, "key").count() == 9500


def test_no_filter_a_large_one_and_odd_keys(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "filter")
    df = spark.createDataFrame([("a",), ("b",), (None,)], "key string")
    none = df.filter("key = 'z'")
    K.add(spark, path, none, "key")
    assert K.unknown(df, none, path, "key").count() == 3
    K.add(spark, path, df, "key")
    assert [r.key for r in K.unknown(df, df, path, "key").collect()] == [None]
    monkeypatch.setattr(K, "MOST_BYTES", 10)
    assert K.maybe_known(df, path, "key") is None and [r.key for r in K.unknown(df, df, path, "key").collect()] == [None]
