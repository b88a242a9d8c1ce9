import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import spatial

SCHEMA = "id long, page int, x0 double, y0 double, x1 double, y1 double, row int, level int"


def boxes(n, seed, hot=0.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = 10 ** rng.uniform(-3, 2.3)  # five orders of magnitude
        x, y = (rng.uniform(0, 3), rng.uniform(0, 3)) if rng.random() < hot else (rng.uniform(-500, 500), rng.uniform(-500, 500))
        out.append((i, 1 if rng.random() < hot else rng.randint(0, 5), x, y, x + size, y + size * rng.uniform(0.2, 1), 0, 0))
    return out


def brute(a, b=None, paged=False):
    out = []
    for i, p in enumerate(a):
        for j, q in enumerate(a if b is None else b):
            if (b is None and j <= i) or None in p[1:6] or None in q[1:6] or (paged and p[1] != q[1]):
                continue
            w, h = min(p[4], q[4]) - max(p[2], q[2]), min(p[5], q[5]) - max(p[3], q[3])
            if w > 0 and h > 0 and all(v[4] > v[2] and v[5] > v[3] for v in (p, q)):
                x, y = (q, p) if b is None and p[0] > q[0] else (p, q)
                out.append((x[0], y[0], round(w * h, 9), round(w * h / ((x[4] - x[2]) * (x[5] - x[3])), 6)))
    return sorted(out)


def rows(df):
    return sorted((r.id_a, r.id_b, round(r.area, 9), round(r.share, 6)) for r in df.collect())


@pytest.mark.parametrize("paged", [False, True])
def test_against_all_pairs(spark, paged):
    one, two = boxes(500, 1, hot=0.35), boxes(300, 2, hot=0.35)
    a, b, page = spark.createDataFrame(one, SCHEMA), spark.createDataFrame(two, SCHEMA), "page" if paged else None
    assert rows(spatial.overlapping(a, page=page)) == brute(one, paged=paged)
    assert rows(spatial.overlapping(a, b, page=page)) == brute(one, two, paged=paged) and len(brute(one, two)) > 100


def test_odd_boxes(spark):
    given = [(1, 0, 0.0, 0.0, 1.0, 1.0), (2, 0, 1.0, 0.0, 2.0, 1.0), (3, 0, 0.5, 0.5, 0.5, 0.9), (4, 0, None, 0.0, 1.0, 1.0), (5, 0, 0.9, 0.9, 0.1, 0.1), (6, None, 0.0, 0.0, 1.0, 1.0), (7, 0, 0.0, 0.0, 1.0, 1.0), (7, 0, 0.0, 0.0, 1.0, 1.0), (8, 0, float("nan"), 0.0, 1.0, 1.0), (9, 0, 0.0, 0.0, float("inf"), 1.0), (10, 0, -1e9, -1e9, 1e9, 1e9), (11, 0, 0.1, 0.1, 0.1 + 1e-12, 0.1 + 1e-12)]
    df = spark.createDataFrame([(*g, 0, 0) for g in given], SCHEMA)
    use = [g for g in given if g[0] not in (3, 4, 5, 6, 8, 9)]
    assert rows(spatial.overlapping(df, page="page")) == brute(use)
    assert spatial.overlapping(df.limit(0)).count() == 0 and spatial.overlapping(df, df.limit(0)).count() == 0


def test_candidates_grow_with_boxes_and_results(spark):
    """What the join on cells compares is a small multiple of boxes and overlaps, with a third of all boxes in one place and very large ones among small ones."""
    seen = {}
    for n in (1000, 4000):
        given = [(*g[:2], *(v * (n / 1000) ** 0.5 for v in g[2:4]), *g[4:]) for g in boxes(n, 3)]
        given = [(i, p, x, y, x + (a - b), y + 1.0, 0, 0) for (i, p, x, y, _, _, _, _), (a, b) in zip(given, [(random.Random(k).uniform(0.5, 3), 0) for k in range(n)])]
        df = spark.createDataFrame(given, SCHEMA)
        own = spatial._dealt(spatial._boxes(df, "id", None, "l"), "l", F.col("l_level"))
        seen[n] = own.groupBy("l_at", "l_cx", "l_cy").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert seen[4000] < 8 * seen[1000] and seen[4000] < 40 * 4000
