import random
from collections import Counter

import numpy as np
import xxhash
from helpers import empty, messy, words

from corvane.llm import components, simhash
from corvane.llm.components import connected_components, local_components


def plain_fingerprint(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    ws = [w for w in ws if w]
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)]
    bits = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for k in range(64):
            bits[k] += h >> k & 1
    return sum(1 << k for k in range(64) if bits[k] * 2 > len(grams))


def brute_components(ids, fps, radius=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint_is_as_defined():
    for t in ("", "a", "A b", "A b\tC", words(1, 50), "a a a a a", "É ß ▁ 𓀀\x00 z\x0bq", words(2, 70_000)):
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


def test_components_match_brute_force(spark):
    rng = random.Random(4)
    base = words(7, 400).split()
    rows = []
    for i in range(60):
        ws = list(base)
        for _ in range(i % 4):
            ws[rng.randrange(len(ws))] = "other"
        rows.append((i + 100, " ".join(ws)))
    rows += [(i, words(i, 40)) for i in range(40)] + [(500, None), (501, ""), (502, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.simhash_components(df).collect()}
    fps = [plain_fingerprint(t or "") for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    assert [got[i].fingerprint for i, _ in rows] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i, _ in rows] == want


def test_messy_and_empty(spark):
    df = messy(spark)
    rows = df.collect()
    out = simhash.simhash_components(df).collect()
    want = brute_components([r.doc_id for r in rows], [plain_fingerprint(r.text or "") for r in rows])
    assert sorted(((r.doc_id, r.component_id) for r in out), key=repr) == sorted(zip((r.doc_id for r in rows), want), key=repr)
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_links_of_dense_and_heavy_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", 50)
    rng = np.random.default_rng(0)
    near = np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 64).astype(np.uint64))
    far = rng.integers(0, 2**63, 600).astype(np.uint64) * np.uint64(2) & ~np.uint64(0xFFFF)  # one block in common: a heavy value
    fps = np.unique(np.concatenate([near, far, far[:50] ^ np.uint64(1 << 40)]))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"))
    got = {r.node: r.root for r in connected_components(edges).collect()}
    want = brute_components(fps.view(np.int64).tolist(), [int(x) for x in fps])
    assert [got.get(x, x) for x in fps.view(np.int64).tolist()] == want


def test_tiles_miss_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) for k in range(0, 64, 5)]))
    a, b = simhash.tiled_links(fps, 3, tile=16)
    root = local_components(len(fps), a, b)
    want = brute_components(list(range(len(fps))), [int(x) for x in fps])
    assert [min(np.flatnonzero(root == r)) for r in root] == want


def test_components_of_a_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(5).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (7, 7)] + [(None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_few_tasks_and_every_path(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 900)] + [(2000 + rng.randrange(400), 2000 + rng.randrange(400)) for _ in range(300)] + [(5000, i) for i in range(5001, 5600)] + [(7, None), (9, 9)]
    rng.shuffle(edges)
    nodes = sorted({x for a, b in edges if b is not None and a != b for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    a, b = np.array([[at[x] for x in e] for e in edges if e[1] is not None and e[0] != e[1]]).T
    want = {x: nodes[r] for x, r in zip(nodes, local_components(len(nodes), a, b))}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    before = max(spark.sparkContext.statusTracker().getJobIdsForGroup(), default=-1)
    assert {r.node: r.root for r in connected_components(df).collect()} == want
    jobs = [x for x in spark.sparkContext.statusTracker().getJobIdsForGroup() if x > before]
    assert len(jobs) < 25  # a round of joins took 16 of them, and such a chain several rounds
    for at_once, broadcast in ((1 << 19, 0), (150, 500_000), (20, 0)):  # several forests a task, ties in levels, rounds of joins
        monkeypatch.setattr(components, "AT_ONCE", at_once)
        monkeypatch.setattr(components, "BROADCAST_ROOTS", broadcast)
        assert {r.node: r.root for r in connected_components(df).collect()} == want


def plain_groups(rows, similarity=0.8):
    sets = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in ((t or "").lower().split() for _, t in rows)]
    ids = [i for i, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if not sets[i] and not sets[j] or both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


def edited(text, every, seed):
    rng = random.Random(seed)
    return " ".join("changed" + str(rng.randrange(999)) if k % every == seed % every else w for k, w in enumerate(text.split()))


def test_near_duplicates_match_brute_force(spark):
    rows = [(i, words(i, 60 + 7 * i)) for i in range(40)]
    rows += [(100 + i, edited(words(i, 60 + 7 * i), 80, i)) for i in range(40)]  # about 0.88 alike
    rows += [(200 + i, edited(words(i, 60 + 7 * i), 12, i)) for i in range(40)]  # far less alike
    rows += [(300, words(3, 81)), (301, words(3, 81).upper()), (302, ""), (303, " "), (304, words(5, 95) + " " + words(6, 60)), (305, "one two"), (306, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(df).collect()}
    assert [got[i] for i, _ in rows] == plain_groups(rows)


def test_near_duplicates_in_dense_and_heavy_classes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", 64)
    base = words(1, 300)
    rows = [(i, edited(base, 150, i)) for i in range(150)] + [(500 + i, words(1000 + i, 300)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(df).collect()}
    assert [got[i] for i, _ in rows] == plain_groups(rows)


def test_near_duplicates_messy_and_empty(spark):
    df = messy(spark)
    out = simhash.near_duplicates(df)
    assert out.count() == df.count() and {r.doc_id: r.group_id for r in out.filter("doc_id is not null").collect()}[6] == 5
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_spanning_edges_connect_the_same_parts():
    rng = np.random.default_rng(3)
    x, y, d = rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.integers(0, 14, 400)
    keep = simhash.spanning_edges(60, x, y, d)
    assert len(keep) < 150 and (local_components(60, x[keep], y[keep]) == local_components(60, x, y)).all()
    kept = simhash.thinned(60, np.tile(x, 2), np.tile(y, 2), np.tile(d, 2))
    assert len(kept) < 800 and (local_components(60, np.tile(x, 2)[kept], np.tile(y, 2)[kept]) == local_components(60, x, y)).all()


def test_near_duplicates_among_close_templates(spark):
    rng = np.random.default_rng(8)
    base = words(77, 300).split()
    rows = []
    for i in range(120):  # each text differs from all others of the template beyond the similarity, but for its own copy
        ws = list(base)
        for k in rng.choice(58, 7, replace=False):
            ws[5 * k] = f"page{i}x{k}"
        rows.append((i, " ".join(ws)))
        if i % 4 == 0:
            for k in rng.choice(58, 4, replace=False):
                ws[5 * k + 2] = f"copy{i}x{k}"
            rows.append((1000 + i, " ".join(ws)))
    want = plain_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(df, radius=40).collect()}
    assert len(set(want)) > 60 and [got[i] for i, _ in rows] == want


def test_parity_sketches_bound_the_difference():
    rng = np.random.default_rng(9)
    for n in (1, 40, 700, 5000):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.r_[x[n // 5 :], rng.integers(0, 2**63, n // 4 + 1).astype(np.uint64)]
        f = simhash.folded([simhash.parity_sketch(x), simhash.parity_sketch(y)])
        assert 0 < np.bitwise_count(f[0] ^ f[1]).sum() <= len(np.setxor1d(x, y)) and not np.bitwise_count(f[0] ^ simhash.folded([simhash.parity_sketch(x)] * 2)[0]).sum() * (len(simhash.parity_sketch(x)) == f.shape[1] * 8)


def test_near_duplicates_at_the_least_similarity(spark):
    """Texts of like length and of similarity 0.80 to 0.83, one to a pair: bits within 14 miss some of them."""
    rows = []
    for k in range(150):
        w = words(7000 + k, 240).split()
        for at in range(k % 30, 240, 48):  # five words differ, so 25 of 236 shingles
            w[at] = f"other{k}x{at}"
        rows += [(2 * k, words(7000 + k, 240)), (2 * k + 1, " ".join(w))]
    want = plain_groups(rows)
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(want[i] == i - 1 for i in range(1, 300, 2)) == 150 and [got[i] for i, _ in rows] == want


def test_keys_of_sets():
    """Unlike sets of like size share no key and are not dealt together; those of similarity 0.8 do."""
    rng = np.random.default_rng(12)
    sets = rng.integers(0, 2**63, (400, 900)).astype(np.uint64)
    keys = [set(simhash.near_keys(x[:800]).tolist()) for x in sets]
    assert len(set().union(*keys)) == 400 * simhash.KEYS
    assert all(k & set(simhash.near_keys(x[89:889]).tolist()) for k, x in zip(keys, sets))
