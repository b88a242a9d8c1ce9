import hashlib
import os
import random

import numpy as np
import pytest
from helpers import empty, messy

from corvane.llm import alignment as A

there = pytest.mark.skipif(not os.path.isdir(A.FOLDER), reason="no tokenizers")
pytestmark = there


@pytest.fixture(scope="module")
def model():
    return A.sides()


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{A.FOLDER}/{A.FILE_A}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{A.FOLDER}/{A.FILE_B}")


def brute(rows, tokenizers):
    """By the definition: a text at a time, a position at a time, all link pairs."""
    a, b = tokenizers
    letters = A.byte_letters()
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, held = [], {}
    for who, text in rows:
        want, ids_a, ids_b = (" " + (text or "")).encode(), [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a, bytes_b = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            docs.append((who, [], 0, 0))
            continue
        ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (bytes_a, bytes_b)]
        groups, now, at_a, at_b, i, j = [], ([], []), 0, 0, 0, 0
        for e in range(1, len(want) + 1):
            if e in ends[0]:
                now[0].append(ids_a[i])
                i += 1
            if e in ends[1]:
                now[1].append(ids_b[j])
                j += 1
            if e in ends[0] and e in ends[1]:
                groups.append(now)
                now = ([], [])
        docs.append((who, groups, len(ids_a), len(ids_b)))
        for pair in {(x, y) for g in groups for x in g[0] for y in g[1]}:
            held[pair] = held.get(pair, 0) + 1
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for who, groups, n_a, n_b in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((who, n_a, n_b, len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def texts():
    rng = random.Random(11)
    bits = ["the", " the", "word", "Straße", "naïve", "日本語のテキスト", "🙂", "👩‍👩‍👧", " ", "  ", "\n", "\t", "1234567", "3.14", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "it's", "WE'LL", "é́", "\x00", "​", "abcabcabc", "zzzzzzz", "=====", "ÀÈÌ", "мир", "नमस्ते", "\r\n", "'", '"quoted"']
    out = [(i, "".join(rng.choices(bits, k=rng.randint(1, 40)))) for i in range(300)]
    out += [(300, None), (301, ""), (302, " "), (303, "   lead and trail   "), (304, "has ▁ mark"), (305, "the same"), (305, "the same"), (None, "no id"), (306, "𓀀" * 500), (307, "a" * 3000), (308, "ab" * 5000), (309, " ".join(rng.choices(bits, k=20_000)))]
    return out


@pytest.mark.parametrize("block,together", [(4096, 1 << 20), (7, 64)])
def test_against_the_definition(spark, model, tokenizers, monkeypatch, block, together):
    rows = texts() if block > 7 else texts()[:150] + texts()[300:309]
    monkeypatch.setattr(A, "BLOCK", block)
    monkeypatch.setattr(A, "TOGETHER", together)
    want = brute(rows, tokenizers)
    got = A.alignment_digest(table(spark, rows), model=model)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_buckets_give_the_same(spark, model, tokenizers):
    rows = texts()[:120]
    got = A.alignment_digest(table(spark, rows).repartition(3), model=model, pairs=50)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, tokenizers)


def test_groups(spark, model, tokenizers):
    rows = texts()[:80]
    a, b = tokenizers
    got = {}
    for r in A.alignment_groups(table(spark, rows), model=model).collect():
        got.setdefault(r.doc_id, []).append(r)
    for who, text in rows:
        groups = sorted(got.get(who, []), key=lambda r: r.start)
        if not groups:
            assert "▁" in text
            continue
        assert [i for g in groups for i in g.a_ids] == a.encode(" " + text, add_special_tokens=False).ids and [i for g in groups for i in g.b_ids] == b.encode(text)
        assert groups[0].start == 0 and groups[-1].end == len((" " + text).encode()) and all(x.end == y.start for x, y in zip(groups, groups[1:]))


def test_wide_groups_are_counted_by_distinct_ids():
    rng = np.random.default_rng(1)
    a, b, na, nb = rng.integers(0, 9, 500), rng.integers(0, 7, 450), np.array([100, 3, 397]), np.array([50, 2, 398])
    want, sa, sb = {}, 0, 0
    for x, y in zip(na, nb):
        for i in a[sa : sa + x]:
            for j in b[sb : sb + y]:
                want[int(i * 10 + j)] = want.get(int(i * 10 + j), 0) + 1
        sa, sb = sa + x, sb + y
    keys, times = zip(*A.linked(a, b, na, nb, 10))
    k, t = A.added(np.concatenate(keys), np.concatenate(times))
    assert dict(zip(k.tolist(), t.tolist())) == want
    A.TOGETHER, kept = 100, A.TOGETHER
    try:
        keys, times = zip(*A.linked(a, b, na, nb, 10))
        k, t = A.added(np.concatenate(keys), np.concatenate(times))
        assert dict(zip(k.tolist(), t.tolist())) == want and max(map(len, keys)) <= 200
    finally:
        A.TOGETHER = kept


def test_fast_encoders_equal_the_plain_ones(tokenizers):
    a, b = tokenizers
    fast_a, fast_b = A.ByteLevel(A._read(f"{A.FOLDER}/{A.FILE_A}")), A.Pieces(A._read(f"{A.FOLDER}/{A.FILE_B}"))
    assert fast_b.cuts
    every = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(2)
    for text in ["".join(rng.choices(every, k=60)) for _ in range(400)] + [t for _, t in texts() if t]:
        assert fast_a.encode(" " + text).tolist() == a.encode(" " + text, add_special_tokens=False).ids
        ids = fast_b.encode_all([text])[0]
        assert ids.tolist() == b.encode(text) if ids is not None else b"".join(fast_b.bytes_of[i] for i in b.encode(text)) != (" " + text).encode()


def test_messy_and_empty_tables(spark, model, tokenizers):
    for t in (messy(spark), empty(spark)):
        rows = [(r.doc_id, r.text) for r in t.select("doc_id", "text").collect()]
        assert sorted((tuple(r) for r in A.alignment_digest(t, model=model).collect()), key=repr) == brute(rows, tokenizers)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query_against_the_definition(spark, tokenizers):
    from corvane.llm.queries import op12_token_alignment

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op12_token_alignment(spark, "/root/testdata/sf0.001").collect()), key=repr) == brute(rows, tokenizers)
