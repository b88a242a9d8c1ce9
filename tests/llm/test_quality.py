import itertools
import os
import zlib

import numpy as np
import pytest
from helpers import empty, messy, words
from pyspark.sql import functions as F

from corvane.llm.crf_quality import fit, forward_backward, line_features, quality, score

FOLDER = "/root/testdata/sf0.01"


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    lines = np.array([3, 1, 4])
    u, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    good, logz, expected = forward_backward(u, lines, trans)
    at, z_all, e_all = 0, 0.0, np.zeros((2, 2))
    for n in lines:
        weight = {y: sum(u[at + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(map(np.exp, weight.values()))
        z_all += np.log(z)
        for i in range(n):
            assert good[at + i] == pytest.approx(sum(np.exp(v) for y, v in weight.items() if y[i]) / z)
        for y, v in weight.items():
            for i in range(n - 1):
                e_all[y[i], y[i + 1]] += np.exp(v) / z
        at += n
    assert logz == pytest.approx(z_all) and np.allclose(expected, e_all)


def test_features_by_hand():
    x, size, lines = line_features([b"AB cd 1!\n\nAB cd 1!", b"", b"x x y"])
    assert lines.tolist() == [3, 1, 1] and size.tolist() == [8, 0, 8, 0, 5]
    assert x[0, 2] == 2 / 8 and x[0, 3] == 1 / 8 and x[0, 6] == 1 / 8 and x[2, 15] == 1 and x[0, 15] == 0 and x[1, 16] == 1
    assert x[4, 11] == pytest.approx(1 / 3) and x[4, 12] == pytest.approx(2 / 3)


def test_learns_from_neighbours():
    good = [(" ".join(words(i, 12).split()).capitalize() + ".\n" + words(i + 1, 9).capitalize() + ".").encode() for i in range(60)]
    bad = [("!!! " * 10 + "\n" + words(i, 9) + " | | |").encode() for i in range(60)]
    x, _, lines = line_features(good + bad)
    model = fit(x, lines, np.array([1] * 60 + [0] * 60))
    s = score(good + bad, model)
    assert (s[:60] > 0.9).all() and (s[60:] < 0.1).all() and ((s >= 0) & (s <= 1)).all()
    assert score([b"", b"\n\n", b"x" * 300_000], model).shape == (3,)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = quality(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels).join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id").filter("held_out").toPandas()
    assert len(got) > 50 and (got.predicted == got.y).mean() >= 0.95


def test_held_out_is_the_fold_and_labels_do_not_leak(spark):
    docs = spark.createDataFrame([(i, (words(i, 30) if i % 2 else "!! " * 30)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    a = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in a.items())
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    b = {r.doc_id: r for r in quality(docs, flipped).collect()}
    assert all(a[i].score == b[i].score for i in a)


def test_messy_and_empty(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (8, 0), (12, 1)], "doc_id long, quality int")
    df = messy(spark)
    out = quality(df, labels)
    assert out.count() == df.count() and out.filter("score is null or score < 0 or score > 1 or predicted is null or held_out is null").count() == 0
    assert quality(empty(spark), labels).count() == 0
    unlabelled = quality(df, labels.limit(0))
    assert {r.score for r in unlabelled.collect()} == {0.5}
