"""Values worked out by hand from the formulas, and independent restatements in plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import metrics as M
from corvane.functions import text as T
from corvane.operators import answers, chunking, conflict, evaluation, lexical, registry, search


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_retrieval_metrics_by_hand(spark):
    hits = spark.createDataFrame([(1, f"d{i}", i) for i in range(1, 6)], "query_id long, id string, rank int")
    qrels = spark.createDataFrame([(1, "d1"), (1, "d3"), (1, "d6"), (2, "d9")], "query_id long, id string")
    got = {(r.query_id, r.k): r for r in evaluation.retrieval_metrics(hits, qrels, (3, 5)).collect()}
    r = got[1, 3]
    assert (r.precision, r.recall, r.rr, r.hit) == (0.666667, 0.666667, 1.0, 1.0)
    assert got[1, 5].ndcg == 0.703918
    assert (got[2, 5].precision, got[2, 5].rr, got[2, 5].ndcg) == (0.0, 0.0, 0.0)


def test_answer_metrics(spark):
    assert one(spark, F.round(M.f1(F.lit("a b c"), F.lit("b c d e")), 6)) == 0.571429
    assert one(spark, M.bleu(F.lit("a b c d"), F.lit("a b c d"))) == 1.0
    assert one(spark, M.bleu(F.lit("a b c d"), F.lit("a x c y"))) == 0.0
    assert one(spark, M.f1(F.lit(""), F.lit("a"))) == 0.0
    assert one(spark, M.exact_match(F.lit("Hello,  World!"), F.lit("hello world"))) == 1.0


def test_word_error_rate(spark):
    def plain(r, h):
        d = list(range(len(h) + 1))
        for i, w in enumerate(r, 1):
            d, old = [i] + [0] * len(h), d
            for j, v in enumerate(h, 1):
                d[j] = min(old[j] + 1, d[j - 1] + 1, old[j - 1] + (v != w))
        return d[-1] / max(len(r), 1)

    rng = random.Random(1)
    rows = [("a b c", "a x c d"), ("", "a"), ("a", ""), ("", "")] + [(" ".join(rng.choices("abcd", k=rng.randint(0, 12))), " ".join(rng.choices("abcd", k=rng.randint(0, 12)))) for _ in range(40)]
    df = spark.createDataFrame(rows, "r string, h string")
    for row in df.withColumn("w", M.wer(F.col("r"), F.col("h"))).collect():
        assert row.w == pytest.approx(plain(row.r.split(), row.h.split()))


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "dog dog bird"), (3, "dog")], "doc_id long, text string")
    idf = {r.token: round(r.idf, 6) for r in lexical.bm25_idf(lexical.postings(docs), lexical.corpus_stats(docs)).collect()}
    assert idf == {"cat": 0.980829, "bird": 0.980829, "dog": 0.133531}
    q = spark.createDataFrame([(1, "cat"), (2, "cat cat"), (3, "nothing")], "query_id long, query string")
    got = {(r.query_id, r.id): r.score for r in lexical.bm25_topk(docs, q).collect()}
    assert got[1, 1] == 0.980829 and got[2, 1] == pytest.approx(2 * got[1, 1], abs=2e-6) and (3, 1) not in got


def test_tokens_keep_other_alphabets(spark):
    assert one(spark, T.tokens(F.lit("Điểm-số 12, x_y"))) == ["điểm", "số", "12", "x_y"]


def test_fusion(spark):
    lists = spark.createDataFrame([(1, "a", 7, 0.8, 1), (1, "b", 7, 0.4, 3), (1, "b", 8, 0.9, 1)], "query_id long, list_id string, id long, score double, rank int")
    rrf = {r.id: r.score for r in search.reciprocal_rank_fusion(lists).collect()}
    assert rrf[7] == 0.032266
    assert {r.id: r.score for r in search.score_fusion(lists).collect()} == {7: 0.6, 8: 0.9}
    vec = spark.createDataFrame([(1, 1, 0.8)], "query_id long, id long, score double")
    lex = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0)], "query_id long, id long, score double")
    got = {r.id: r.score for r in search.hybrid(vec, lex, 5, 0.7).collect()}
    assert got == {1: 0.71, 2: 0.3}


def test_knn_matches_brute_force_and_ties(spark):
    rng = random.Random(2)
    pts = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(100, [0.0] * 8), (101, None)]
    pts.append((102, pts[0][1]))
    df = spark.createDataFrame(pts, "vec_id long, embedding array<double>")
    for metric in ("cosine", "dot", "euclid"):
        got = {(r.query_id, r.rank): r.id for r in search.knn(df, df.filter("vec_id < 5"), 4, metric).collect()}
        for q in range(5):
            def score(p):
                a, b = pts[q][1], p[1]
                d = sum(x * y for x, y in zip(a, b))
                n = math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
                return {"dot": d, "cosine": d / n if n else 0.0, "euclid": -math.dist(a, b)}[metric]
            want = sorted((p for p in pts if p[1]), key=lambda p: (-round(score(p), 6), p[0]))[:4]
            assert [got[q, r] for r in range(1, 5)] == [p[0] for p in want]


def test_lsh_recall(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    pts = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 5]]) for i in range(200)]
    df = spark.createDataFrame(pts, "vec_id long, embedding array<double>")
    exact = {(r.query_id, r.id) for r in search.knn(df, df.filter("vec_id < 20"), 5).collect()}
    near = {(r.query_id, r.id) for r in search.knn_lsh(df, df.filter("vec_id < 20"), 5, tables=12).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def _sliced(monkeypatch):
    """Scores are made for SLICE at most at a time; a task that makes more fails."""
    from corvane.operators import search as module

    scores, most = module._scores, (512, 4096)

    def checked(q, p, metric):
        assert len(q) <= most[0] and len(p) <= most[1]
        return scores(q, p, metric)

    monkeypatch.setattr(module, "_scores", checked)


def test_knn_holds_a_slice_of_scores_at_a_time(spark, monkeypatch):
    import numpy as np

    _sliced(monkeypatch)
    v = np.round(np.random.default_rng(4).standard_normal((5000, 4)), 1)
    v[100:200] = v[7]  # copies: ties go to the smaller id, over slices too
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").coalesce(1)
    got = {(r.query_id, r.rank): r.id for r in search.knn(df, df.filter("vec_id % 8 = 0"), 5, "dot", exclude_self=True).collect()}
    s = np.round(v[::8] @ v.T, 6)
    s[np.arange(len(s)), np.arange(0, 5000, 8)] = -np.inf
    want = np.lexsort((np.broadcast_to(np.arange(5000), s.shape), -s), axis=1)[:, :5]
    assert got == {(8 * q, r + 1): int(i) for q, row in enumerate(want) for r, i in enumerate(row)}


def test_knn_lsh_makes_no_rows_of_pairs(spark, monkeypatch):
    import numpy as np

    _sliced(monkeypatch)
    v = np.random.default_rng(5).standard_normal((600, 64))
    v[300:340] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(3, v[9].tolist()), (700, None)]  # an id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    hits = search.knn_lsh(df, df.filter("vec_id < 50"), 6)
    assert "Join" not in hits._jdf.queryExecution().toString()
    v, ids = np.concatenate([v, v[9:10]]), np.r_[np.arange(600), 3]
    planes = np.random.default_rng(7).standard_normal((12, 6, 64))
    bits = np.einsum("tbd,nd->ntb", planes, v) >= 0
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for q in np.flatnonzero(ids < 50):
        near = ((bits != bits[q]).sum(axis=2) <= 1).any(axis=1)
        want.setdefault(int(ids[q]), []).extend((-round(float(unit[q] @ unit[p]), 6), int(ids[p])) for p in np.flatnonzero(near))
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.id))
    assert got == {q: sorted(x)[:6] for q, x in want.items()}


def test_true_mmr_prefers_diverse_points(spark):
    pts = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.6, 0.8])], "vec_id long, embedding array<double>")
    hits = spark.createDataFrame([(9, 1, 0.9), (9, 2, 0.89), (9, 3, 0.7)], "query_id long, id long, score double")
    assert [r.id for r in search.true_mmr(hits, pts, 2).orderBy("rank").collect()] == [1, 3]


def test_rerank_leaves_short_lists(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 2), (2, 1, 0.5, 1)], "query_id long, id long, score double, rank int")
    new = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.7), (2, 1, 0.0)], "query_id long, id long, new_score double")
    got = [(r.query_id, r.id, r.score) for r in search.rerank(hits, new, 1).orderBy("query_id").collect()]
    assert got == [(1, 2, 0.7), (2, 1, 0.5)]


def test_fixed_offset_starts(spark):
    df = spark.createDataFrame([(1, "x" * 1200), (2, ""), (3, None)], "doc_id long, text string")
    assert [r.start for r in chunking.fixed_offset(df).orderBy("start").collect()] == [0, 450, 900]


def test_snapped_windows_always_end():
    assert "".join(chunking.snapped_windows("y" * 1000, 100, 99)) != ""
    text = " ".join(f"word{i}" for i in range(300))
    got = chunking.snapped_windows(text, 100, 20)
    assert set(text.split()) <= set(" ".join(got).split()) and max(map(len, got)) <= 100


def test_sentence_packing_covers_text():
    text = " ".join(f"Sentence number {i} ends here." for i in range(50))
    got = chunking.pack_sentences(text, 200, 0)
    assert " ".join(got) == text
    assert len(chunking.pack_sentences(text, 200, 30)) >= len(got)


def test_recursive_split_respects_size():
    text = "\n\n".join("word " * n for n in (5, 80, 300)) + "z" * 700
    got = chunking.split_recursive(text, 200, 20)
    assert max(map(len, got)) <= 200 and re.sub(r"\s", "", text)[-100:] in re.sub(r"\s", "", "".join(got))


def test_merge_short_and_lines():
    assert chunking.merge_short(["a", "b", "c" * 100, "d"], 3) == ["a b", "c" * 100, "d"]
    assert chunking.pack_lines("One. Two.\nThree.", 11) == ["One. Two.", "Three."]
    assert chunking.pack_lines("x" * 30 + ". Yes.", 10) == ["x" * 30 + ".", "Yes."]


def test_segments_keep_times():
    seg = [{"id": i, "start": float(i), "end": i + 1.0, "text": "t" * 40} for i in range(3)]
    got = chunking.pack_segments(seg, 90, 10)
    assert [(c["start_time"], c["end_time"], c["duration"], c["segment_ids"]) for c in got] == [(0.0, 2.0, 2.0, [0, 1]), (2.0, 3.0, 1.0, [2])]
    assert chunking.pack_segments([], 90, 10) == []


def test_equal_similarities_make_no_break(spark):
    df = spark.createDataFrame([(1, i, 0.5 if i else None) for i in range(5)], "g long, i long, similarity double")
    assert not any(r.is_break for r in chunking.break_groups(df, "g", "i").collect())


def test_semantic_chunks_hold_all_words(spark):
    text = " ".join(f"The cat number {i} sat on the mat." if i < 15 else f"Stock prices rose by {i} points today." for i in range(30))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = chunking.chunk(df, "semantic").orderBy("chunk_index").collect()
    assert {r.doc_id for r in got} == {1} and set(text.split()) <= set(" ".join(r.chunk for r in got).split())


def test_semantic_chunks_need_no_shuffle_and_break_as_groups_do(spark):
    from corvane.functions.vectors import cosine, hashed_embedding

    rng = random.Random(6)
    texts = [" ".join(f"{' '.join(rng.choices(['Katze', 'Äpfel', 'HUND', 'x_1', 'sóng', '7'], k=rng.randint(0, 6)))}{rng.choice('.!?')}" for _ in range(rng.randint(1, 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate([*texts, "one. one. one. two. two. two.", None, ""])), "doc_id long, text string")
    got = chunking.chunk(df, "semantic", 120, 20)
    assert "Exchange" not in got._jdf.queryExecution().toString()
    s = chunking.sentence_rows(df).withColumn("v", hashed_embedding(F.col("sentence"))).toPandas()
    steps = [(d, p, x, v, w) for (d, p, x, v), w in zip(s.values.tolist(), [None, *s["v"].tolist()])]
    steps = spark.createDataFrame([(d, p, x, v, w if p else None) for d, p, x, v, w in steps], "doc_id long, position int, sentence string, v array<double>, w array<double>")
    steps = steps.withColumn("similarity", F.when(F.col("w").isNotNull(), F.round(cosine(F.col("v"), F.col("w")), 9)))
    parts: dict = {}
    for r in chunking.break_groups(steps.drop("v", "w"), "doc_id", "position").orderBy("doc_id", "position").collect():
        parts.setdefault(r.doc_id, {}).setdefault(r.block, []).append(r.sentence)
    want = {d: [c for p in chunking.merge_short([" ".join(x) for x in blocks.values()]) for c in chunking.split_recursive(p, 120, 20)] for d, blocks in parts.items()}
    rows: dict = {}
    for r in got.orderBy("doc_id", "chunk_index").collect():
        rows.setdefault(r.doc_id, []).append(r.chunk)
    assert rows == {d: x for d, x in want.items() if x}


def test_quality_and_confidence(spark):
    hits = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.6), (1, 3, 0.3)], "query_id long, id long, score double")
    assert answers.retrieval_quality(hits).first().quality == 0.709091
    c = lambda *v: one(spark, F.round(answers.confidence(*[F.lit(x) for x in v]), 6))
    assert c(1.0, 0.5, 0, 2) == 0.8 and c(1.0, 0.5, 4, 2) == 0.5 and c(0.0, 0.0, 0, 0) == 0.0
    assert one(spark, answers.grounding_level(F.lit(0.8), F.lit(0.7), F.lit(0))) == "fully_grounded"


def test_verify(spark):
    df = spark.createDataFrame([(1, "There is no information here.", "x"), (2, "The limit is 500 for Members everywhere.", "A limit of 500 holds for members."), (3, "Perhaps Paris wins 77 of all games.", "nothing")], "id long, answer string, context string")
    got = {r.id: r for r in answers.verify(df).collect()}
    assert (got[1].level, got[1].confidence) == ("fully_grounded", 1.0)
    assert got[2].n_grounded == 1 and got[2].action.startswith("accept") and got[3].action == "abstain"


def test_abstention_reasons(spark):
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    h = spark.createDataFrame([(2, 1, 0.2), (3, 1, 0.8), (4, 1, 0.8), (4, 2, 0.7)], "query_id long, id long, score double")
    assert {r.query_id: r.reason for r in answers.abstention(q, h, 0.3, 2).collect()} == {1: "no_hits", 2: "low_similarity", 3: "too_few_relevant", 4: "answer"}


def test_compression_and_budget(spark):
    df = spark.createDataFrame([(1, 1, 1, "red fox", "A red fox ran away. Nothing to see here. The fox slept all day"), (1, 2, 2, "red fox", "No match in this text")], "query_id long, id long, rank int, query string, text string")
    got = answers.extractive_compress(df).collect()
    assert [r.compressed for r in got] == ["A red fox ran away The fox slept all day"]
    assert answers.hybrid_compress(df, least=0.0).count() == 1
    b = answers.context_budget(df, 8).first().context
    assert b == "1. " + df.first().text[:32] + "..."


def test_dates(spark):
    d = lambda t: one(spark, T.text_date(F.lit(t)).cast("string"))
    assert d("ngày 5/3/2021") == "2021-03-05" and d("ngày 31/02/2021, năm 2020") == "2020-01-01" and d("on 2023-07-09") == "2023-07-09"
    assert d("tháng 7/2022") == "2022-07-01" and d("version 2") is None
    p = lambda t: one(spark, T.parse_date(F.lit(t)).cast("string"))
    assert p("2024-02-30") is None and p("01/02/2024") == "2024-02-01" and p("2024/2/1") == "2024-02-01" and p("2024-01") is None


def test_key_values_and_conflicts(spark):
    assert one(spark, T.key_values(F.lit("speed: 5; the limit = 50%"))) == {"speed": "5", "the limit": "50%"}
    rows = spark.createDataFrame([(1, 1, "limit: 5.0", None, "q"), (1, 2, "limit: 50", None, "q"), (1, 3, "limit: 7 new", None, "q")], "query_id long, id long, text string, date string, query string")
    got = {(r.id_a, r.id_b): r.kind for r in conflict.conflict_pairs(rows).collect()}
    assert got == {(1, 3): "version", (2, 3): "version"}


def test_resolution_strategies(spark):
    rows = spark.createDataFrame([(1, 1, "limit: 5 old", "2015-01-01", 0.9), (1, 2, "limit: 7 new", "2024-01-01", 0.5), (1, 3, "limit: 7 new", "2020-01-01", 0.4)], "query_id long, id long, text string, date string, similarity double")
    ids = lambda s, **k: [r.id for r in conflict.resolve(rows, "2025-01-01", s, **k).orderBy("rank").collect()]
    assert ids("prefer_newer") == [2, 1] and ids("prefer_higher_score") == [1, 2, 3] and ids("manual_review") == [1, 2, 3]
    pairs = conflict.conflict_pairs(rows.withColumn("query", F.lit("q")))
    assert sum(r.note != "" for r in conflict.resolve(rows, "2025-01-01", "show_all_versions", conflicts=pairs).collect()) == 3
    with pytest.raises(ValueError):
        conflict.resolve(rows, "2025-01-01", "guess")


def test_date_boost(spark):
    rows = spark.createDataFrame([(1, 0.8, "plain", "2024-01-01"), (2, 0.8, "plain", None)], "id long, score double, text string, date string").withColumn("date", F.col("date").cast("date"))
    got = {r.id: r.boosted for r in search.date_boost(rows, "2024-12-31").collect()}
    assert got == {1: 0.8, 2: 0.74}


def test_synonyms(spark):
    q = spark.createDataFrame([(1, "What is AI"), (2, "zzz")], "query_id long, query string")
    got = [(r.query_id, r.variant) for r in lexical.expand_synonyms(q).orderBy("query_id", "position").collect()]
    assert got[0] == (1, "What is AI") and (1, "what is artificial intelligence") in got and len([g for g in got if g[0] == 1]) == 4 and got[-1] == (2, "zzz")


def test_registry_changes(spark):
    reg = spark.createDataFrame([("a", "h1", ["x", "y"], {"k": "v"}), ("b", "h2", ["x"], {})], "id string, file_hash string, tags array<string>, metadata map<string,string>")
    assert [r.id for r in registry.registry_filter(reg, tags=["x", "y"]).collect()] == ["a"]
    assert registry.upsert(reg, reg.filter("id = 'a'")).count() == 2 and registry.remove(reg, reg.filter("id = 'a'")).count() == 1
    m = registry.merge_metadata(reg, F.create_map(F.lit("k"), F.lit("new"))).filter("id = 'a'").first().metadata
    assert m == {"k": "new"} and registry.delete_by_filter(reg, {"id": "a"}).count() == 1


def test_duplicate_contents(spark):
    batch = spark.createDataFrame([("p1", "A"), ("p2", "A"), ("p3", "B"), ("p4", "C")], "path string, content string")
    known = spark.createDataFrame([("0d61f8370cad1d412f80b84d143e1257", "old")], "file_hash string, id string")  # md5 of C
    new, dup = registry.fresh_documents(batch, known)
    assert {r.path for r in new.collect()} == {"p1", "p3"} and {(r.path, r.existing_id) for r in dup.collect()} == {("p2", None), ("p4", "old")}
    with pytest.raises(Exception):
        registry.fresh_documents(batch, known, fail=True)[1].collect()


def test_bbox_is_not_symmetric(spark):
    a, b = (F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), box)]) for box in ((0, 0, 2, 2), (1, 1, 4, 4)))
    assert one(spark, registry.bbox_overlap(a, b)) == 0.25 and one(spark, F.round(registry.bbox_overlap(b, a), 6)) == 0.111111


def test_cache_ttl_and_eviction(spark):
    c = spark.createDataFrame([(str(i), i, f"2024-01-0{i} 00:00:00") for i in range(1, 6)], "key string, bytes long, used_at string").withColumn("used_at", F.to_timestamp("used_at")).withColumn("created_at", F.col("used_at"))
    assert {r.key for r in registry.cache_evict(c, 12).collect()} == {"4", "5"} and registry.cache_evict(c, 15).count() == 5
    assert registry.cache_live(c, "2024-01-05 12:00:00").count() == 1


def test_bleu_looks_ngrams_up_in_a_set(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("abcde", k=rng.randrange(0, 40))), " ".join(rng.choices("abcde", k=rng.randrange(0, 40)))) for i in range(60)] + [(60, None, "a")]
    df = spark.createDataFrame(rows, "i int, p string, t string").select("i", M.bleu(F.col("p"), F.col("t")).alias("b"))
    assert "array_contains" not in df._jdf.queryExecution().toString()

    def bleu(p, t):
        p, t = p.split(), t.split()
        grams = lambda x, n: [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]
        used = min(len(p), 4)
        hits = [sum(g in grams(t, n) for g in grams(p, n)) for n in range(1, used + 1)]
        if not p or not t or 0 in hits:
            return 0.0
        return (1.0 if len(p) >= len(t) else math.exp(1 - len(t) / len(p))) * math.exp(sum(math.log(h / (len(p) - n)) for n, h in enumerate(hits)) / used)

    got = {r.i: r.b for r in df.collect()}
    assert all(got[i] == pytest.approx(bleu(p, t)) for i, p, t in rows if p is not None)


def test_chunks_in_conflict_are_found_without_pairs(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(6), i // 2, f"fee is {rng.randrange(3)}. rate: {rng.choice(['5%', '5.%', '7%'])}" if rng.random() < 0.8 else "none", 0.1 * i % 1, "q") for i in range(60)]
    df = spark.createDataFrame(rows, "query_id long, id long, text string, similarity double, query string")
    pairs = conflict.conflict_pairs(df, date_col=None)
    want = {(r.query_id, i) for r in pairs.collect() for i in (r.id_a, r.id_b)}
    marked = conflict.in_conflict(df)
    assert {tuple(r) for r in marked.collect()} == want and want
    assert "Join" not in marked._jdf.queryExecution().toString()
    got = conflict.resolve_by_all(df, date_col=None)
    for s in conflict.STRATEGIES[1:]:
        one = conflict.resolve(df, "2025-01-01", s, date_col=None, conflicts=pairs).select("query_id", "id", "rank", F.col("note") if s in ("merge_all", "show_all_versions") else F.lit("").alias("note"))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, got.filter(F.col("strategy") == s).drop("strategy").collect()))


def test_label_metrics_are_those_of_all_pairs_of_a_label(spark):
    e = spark.createDataFrame([(i, i % 3 if i < 18 else 7) for i in range(19)] + [(4, 1), (5, 0)], "vec_id long, label int")  # 4 and 5 occur twice, 18 has no other of its label
    q = e.filter("vec_id % 2 = 0")
    hits = spark.createDataFrame([(m, i, (i * s + r) % 19, r) for m, s in (("a", 1), ("b", 5)) for i in range(0, 19, 2) for r in range(1, 6) if (i * s + r) % 19 != i], "method string, query_id long, id long, rank int")
    other = e.select(F.col("vec_id").alias("id"), F.col("label").alias("l"))
    qrels = q.join(other, F.col("label") == F.col("l")).filter("vec_id <> id").select(F.col("vec_id").alias("query_id"), "id")
    got, want = (sorted(map(tuple, x.collect())) for x in (evaluation.label_metrics(hits, q, e, keys=("method", "query_id")), evaluation.retrieval_metrics(hits, qrels, keys=("method", "query_id"))))
    assert got == want and len(got) == 9 * 2 * 4
