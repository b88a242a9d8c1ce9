import hashlib
from collections import defaultdict

from helpers import empty, messy, words
from pyspark.sql import functions as F

from corvane.llm.exact_dedup import exact_dedup
from corvane.llm.line_dedup import line_dedup

FOLD = {c: c + 32 for c in range(65, 91)}


def test_exact_dedup_matches_brute_force(spark):
    df = messy(spark)
    for keep, best in (("min", min), ("max", max)):
        groups = defaultdict(list)
        for r in df.collect():
            groups[(r.text or "").translate(FOLD)].append(r.doc_id)
        want = []
        for t, ids in groups.items():
            k = best([i for i in ids if i is not None], default=None)
            want += [(i, k, len(ids), i == k, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
        got = [tuple(r) for r in exact_dedup(df, keep=keep).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_keeps_case_if_asked(spark):
    got = {r.doc_id: r.keep_id for r in exact_dedup(messy(spark).filter("doc_id < 3"), fold_case=False).collect()}
    assert got == {1: 1, 2: 2}


def test_exact_dedup_folds_only_ascii(spark):
    df = spark.createDataFrame([(1, "É"), (2, "é"), (3, "A"), (4, "a")], "doc_id long, text string")
    assert {r.doc_id: r.group_size for r in exact_dedup(df).collect()} == {1: 1, 2: 1, 3: 2, 4: 2}


def brute_lines(docs):
    """docs: [(id, text)] with distinct ids."""
    first, out = {}, {}
    spots = []
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]) + [d for d in docs if d[0] is None]:
        ls = (t or "").split("\n")
        for p in range(len(ls) - 2):
            w = "\n".join(ls[p : p + 3])
            first.setdefault(w, (i, p))
            spots.append((i, p, w))
    cut = defaultdict(set)
    for i, p, w in spots:
        f = first[w]
        if (i, p) != f:
            cut[i] |= set(range(max(p, f[1] + 3) if i == f[0] else p, p + 3))
    for i, t in docs:
        out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut[i]) if t and cut[i] else t
    return out


def test_line_dedup_matches_brute_force(spark):
    docs = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\na\na\na\na\na"), (4, "a\nb\nc"), (5, "q\n\n\n\nr"), (6, None), (7, ""), (8, "b\nc\nd\ne\nf"), (9, "\n".join(words(i, 3) for i in range(300)) + "\na\nb\nc\nd"), (10, "c\nd\ne\nf")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup(df).collect()}
    assert got == brute_lines(docs) and got[2] == "x\ny" and got[3] == "a\na\na" and got[4] == ""


def test_line_dedup_messy(spark):
    df = messy(spark)
    out = line_dedup(df)
    assert out.count() == df.count() and out.columns == [*df.columns, "n_lines", "n_removed"]
    assert out.filter("doc_id = 9").first().text == "x\ny" and out.filter("doc_id = 7").count() == 2
    assert out.filter("text is null").count() == df.filter("text is null").count() and line_dedup(empty(spark)).count() == 0
    assert line_dedup(df, counts=None).columns == df.columns


def test_line_dedup_same_id_other_text(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "z\na\nb\nc"), (1, "a\nb\nc")], "doc_id long, text string")
    got = sorted(r.text for r in line_dedup(df).collect())
    assert "z" in got or got.count("") >= 1
    assert len(got) == 3 and df.select(F.count("*")).first()[0] == 3


def test_line_dedup_of_a_long_text_is_linear(spark):
    import time

    body = "\n".join(f"line {i}" for i in range(40_000))
    df = spark.createDataFrame([(1, body), (2, body + "\nown line")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(df).collect()}
    assert got == {1: (body, 0), 2: ("own line", 40_000)} and time.perf_counter() - began < 60
