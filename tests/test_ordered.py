import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import ordered as O


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_same_as_windows_over_whole_keys(spark, parts):
    rng = random.Random(parts)
    keys = [0] * 600 + [None] * 200 + [rng.randint(1, 30) for _ in range(400)]  # half of the rows under one key
    rows = [(k, i, rng.randint(-5, 5), f"v{i}") for i, k in enumerate(rng.sample(keys, len(keys)))]
    df = spark.createDataFrame(rows, "k int, o int, n long, v string")
    dealt = O.dealt_in_order(df, "k", "o", parts)
    if parts > 1:
        assert dealt.filter("k = 0").select(O.PART).distinct().count() >= parts // 3  # the large key is in many parts
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("k", "o", F.lag("v").over(w).alias("previous_v"), F.lag("n").over(w).alias("previous_n"), (F.row_number().over(w) == 1).alias("is_first"))
    got = O.with_previous(dealt, "k", "o", ["v", "n"]).select("k", "o", "previous_v", "previous_n", "is_first")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    want = df.select("k", "o", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    assert sorted(map(tuple, O.with_running_sum(dealt, "k", "o", "n", "s").select("k", "o", "s").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, None), (1, 2, 5), (1, 3, None), (None, None, 1)], "k int, o int, n long")
    rows = O.with_previous(O.dealt_in_order(df, "k", "o", 3), "k", "o", ["n"]).collect()
    assert sorted((r.k or 0, r.o or 0, r.previous_n, r.is_first) for r in rows) == [(0, 0, None, True), (1, 0, None, True), (1, 2, None, False), (1, 3, 5, False)]
    assert O.with_running_sum(O.dealt_in_order(df, "k", "o", 3), "k", "o", "n", "s").filter("k = 1").agg(F.max("s")).first()[0] == 5
    assert O.with_previous(O.dealt_in_order(df.limit(0), "k", "o"), "k", "o", ["n"]).count() == 0
