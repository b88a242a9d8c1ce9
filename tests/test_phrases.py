import random
import re

import pytest

from corvane.functions import phrases as P


def naive(texts, phrases, whole):
    out = []
    for i, t in texts:
        for k, p in phrases:
            if not t or not p:
                continue
            t2, p2 = t.lower(), p.lower()
            at = t2.find(p2)
            while at >= 0:
                inside = lambda a, b: re.match(r"\w\w", a + b) is not None if a and b else False
                if not whole or not (inside(t2[at - 1 : at], t2[at]) or inside(t2[at + len(p2) - 1], t2[at + len(p2) : at + len(p2) + 1])):
                    out.append((i, k, at, at + len(p2)))
                at = t2.find(p2, at + 1)
    return sorted(out, key=repr)


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("most", [1 << 20, 200])
def test_against_one_search_for_each_phrase(spark, whole, most):
    rng = random.Random(6)
    letters = ["a", "b", "ab", " ", "é", "𓀀", "ba ", "_", "-", "A"]
    texts = [(i, "".join(rng.choices(letters, k=rng.randint(0, 60)))) for i in range(80)] + [(90, None), (91, ""), (7, "aaaa"), (None, "ab ab")]
    phrases = [(k, "".join(rng.choices(letters, k=rng.randint(1, 4)))) for k in range(60)] + [(100, "aa"), (101, "aa"), (102, ""), (103, None), (104, "absent word")]
    got = P.phrase_places(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(phrases, "phrase_id long, phrase string"), whole_words=whole, most_bytes=most)
    assert got.columns == ["doc_id", "phrase_id", "start", "end"]
    assert sorted(map(tuple, got.collect()), key=repr) == naive(texts, phrases, whole)


def test_no_phrases(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "phrase_id long, phrase string")
    assert P.phrase_places(docs, none).count() == 0 and P.phrase_counts(docs, none).columns == ["doc_id", "phrase_id", "n"]
