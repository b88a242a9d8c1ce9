import math
import os
import random

import pytest
from oracle import compare

from corvane.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, row int, id string, norm int, place int, score int"
EXTRA = (1, "x", 2, 3, 4)


def brute(rows, every=50, positives=5, negatives=3):
    """By the definition, over rows (id, vector, label) in the order of the table."""
    use = []
    for at, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label
        use.append((at, i, [math.floor(256 * x) for x in v], label))
    out, order = [], lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    for at, i, v, label in use:
        if i is None or i % every:
            continue
        near = [(max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(v, w)))), j, k, tag) for k, j, w, tag in use if k != at]
        for score, j, _, _ in sorted((r for r in near if r[3] == label), key=order)[:positives]:
            far = sorted((r for r in near if r[3] != label and 50 * score <= 100 * r[0] <= 95 * score), key=order)[:negatives]
            out += [(i, j, n, r[1], score, r[0]) for n, r in enumerate(far, 1)]
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).coalesce(1)
    out = H.hard_negatives(H.relabelled(df), **kw)
    assert [c for c, _ in out.dtypes] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def vectors(n, size, seed, spread=1.0, label=lambda rng: rng.randint(0, 3)):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(4)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centre)], label(rng)) for i in range(n)]


@pytest.mark.parametrize("bucket,anchors,first", [(1024, 16_384, 4), (16, 4, 1)])
def test_against_the_definition(spark, monkeypatch, bucket, anchors, first):
    for name, value in (("BUCKET", bucket), ("ANCHORS", anchors), ("FIRST", first), ("GROWTH", 2)):
        monkeypatch.setattr(H, name, value)
    rows = vectors(700, 6, 1)
    assert run(spark, rows) == brute(rows) and len(brute(rows)) > 50


def test_ties_repeats_nulls_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET", 32)
    rows = vectors(260, 3, 2)
    rows = [(i, [float(round(x)) for x in v], t) for i, v, t in rows]  # many equal scores
    rows += [(0, [1.0, 1.0, 0.0], 1)] * 3 + [(50, [1.0, 0.0, 0.0], 2)] * 40 + [(None, [2.0, 1.0, 0.0], k % 3) for k in range(5)]
    rows += [(300, None, 1), (301, [1.0, None, 2.0], 1), (302, [float("nan"), 1.0, 1.0], 1), (303, [float("inf"), 1.0, 1.0], 2), (304, [1.0, 1.0, 1.0], None), (350, [], 1), (400, [0.0, 0.0, 0.0], 0), (450, [1.0], 1), (500, [3.0, 2.0, 1.0, 4.0], 0), (550, [-1.0, -1.0, -1.0], -4), (-50, [1.0, 2.0, 1.0], -13)]
    want = brute(rows)
    assert run(spark, rows) == want and len(want) > 50


@pytest.mark.parametrize("scale", [30.0, 1e5, 1e12])
def test_large_components_are_exact(spark, scale):
    rows = [(i, [x * scale for x in v], t) for i, v, t in vectors(160, 5, 3)]
    assert run(spark, rows) == brute(rows)


def test_no_candidates(spark):
    assert run(spark, []) == [] and run(spark, [(50, [1.0], 1)]) == [] and run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_short_lists(spark):
    rows = [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.75, 0.0], 2), (53, [0.96, 0.0], 2), (54, [0.4, 0.0], 2)]
    assert run(spark, rows) == [(50, 51, 1, 52, 65536, 49152)]


def test_pruning_skips_short_vectors(spark, monkeypatch):
    """Candidates that are too short for every window are not multiplied."""
    seen = []
    monkeypatch.setattr(H, "BUCKET", 8)
    rows = [(i, [4.0 - i / 100, 1.0], i % 2) for i in range(100)] + [(1000 + i, [0.01, 0.0], i % 2) for i in range(3000)]
    old = H.products
    assert run(spark, rows) == brute(rows)
    made = H.quantised(H.relabelled(spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).coalesce(1)))
    buckets = [r.asDict() for r in H.norm_buckets(made, "<i2", 2, 4).collect()]
    assert sum(len(b["ids"]) // 8 for b in buckets) == 3100 and sorted((b["part"], -b["norm"]) for b in buckets) == [(b["part"], -b["norm"]) for b in sorted(buckets, key=lambda b: (b["part"], b["bucket"]))]

    def counted(a, b, kind):
        seen.append(a.shape[0] * b.shape[0])
        return old(a, b, kind)

    import pyarrow as pa
    from types import SimpleNamespace

    block = pa.table({"row": pa.array([0], pa.int64()), "id": pa.array([0], pa.int64()), "label": pa.array([1], pa.int64()), "norm": [1100.0], "v": pa.array([__import__("numpy").array([1024.0, 256.0]).tobytes()], pa.binary()), "place": pa.array([1], pa.int32()), "low": pa.array([500_000], pa.int64()), "high": pa.array([900_000], pa.int64()), "least": pa.array([H.NONE], pa.int64())})
    batch = pa.Table.from_pylist(sorted(buckets, key=lambda b: (b["part"], b["bucket"]))).to_batches()
    caught = {}
    fake = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v))), mapInArrow=lambda f, s: caught.update(f=f))
    monkeypatch.setattr(H, "products", counted)
    H.search(fake, block, 3, 2e6, False, 2, "<i2")
    list(caught["f"](iter(batch)))
    assert 0 < sum(seen) <= 120


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_query_against_sql(spark):
    from corvane.llm.queries import QUERIES, SQL

    compare(spark, QUERIES["op13_hard_negatives"], SQL["op13_hard_negatives"], "/root/testdata/sf0.01")
