import math

import pytest
from helpers import empty, messy, words
from pyspark.sql import functions as F

from corvane.llm.mixing import SHARE, WEIGHTS, mix


def fill(sizes, weights=WEIGHTS, share=SHARE):
    """Targets by resharing the excess over and over."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, goal, out = set(names), share * sum(sizes.values()), {}
    while True:
        total = sum(w[s] for s in left)
        over = {s for s in left if goal * w[s] / total > 2 * sizes[s] * (1 + 1e-12)} if total else set()
        if not over:
            return out | {s: goal * w[s] / total if total else 0 for s in left}
        for s in over:
            out[s] = 2.0 * sizes[s]
            goal -= out[s]
        left -= over


def corpus(spark, n=1500):
    rows = [(i, words(i, 1 + (i * 37) % 90 if i % 50 else 900), f"s{i % 7 if i % 3 else 0}" if i % 11 else None) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_targets_taken_and_bounds(spark):
    df, rows = corpus(spark)
    got = mix(df).collect()
    size, source = {}, {i: s for i, _, s in rows}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    want = fill(size)
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert len(got) == len(rows) and sum(want.values()) == pytest.approx(SHARE * sum(size.values()))
    for s in size:
        assert abs(taken[s] - want[s]) <= 450 + 1e-6  # half the largest document


def test_rates_solve_the_dual(spark):
    df, rows = corpus(spark, 400)
    source = {i: s for i, _, s in rows}
    got = mix(df).collect()
    by = {}
    for r in got:
        by.setdefault(source[r.doc_id], []).append(r)
    for rs in by.values():
        assert sum(r.rate * r.size for r in rs) == pytest.approx(rs[0].target, rel=1e-6)
        free = {round(math.log(r.rate) / r.size, 9) for r in rs if r.size and 1e-6 < r.rate < 2}
        assert not free or max(free) - min(free) < 1e-7  # log of the rate is proportional to the size


def test_reruns_and_partitions_agree(spark):
    df, _ = corpus(spark, 300)
    a = sorted(map(tuple, mix(df).select("doc_id", "taken").collect()))
    assert a == sorted(map(tuple, mix(df.repartition(7)).select("doc_id", "taken").collect()))


def test_messy_and_empty(spark):
    df = messy(spark)
    out = mix(df)
    assert out.count() == df.count() and out.filter("size = 0 and taken <> 0").count() == 0
    carried = mix(df, carry=True)
    assert carried.columns == [*df.columns, "__copies"] and carried.count() == df.count() and carried.filter("target <> 3.0").count() == 0
    assert mix(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert mix(nothing).agg(F.sum("taken")).first()[0] == 0


def test_target_may_be_all_of_a_source_twice(spark):
    df = spark.createDataFrame([(1, "a b c", "big"), (2, "d", "small")] + [(i, words(i, 50), "big") for i in range(3, 9)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mix(df, weights=(1.0, 100.0)).collect()}
    assert got[2].target == 2.0 and got[2].taken == 2
