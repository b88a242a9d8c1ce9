"""Small tables that every operator must take: nulls, empty and very long texts, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, t string, h string, size long, target double, score double, rank int, key long, fp long, node long, root long, copies long, a long, b long, l int"
EXTRA = (1, "t", "h", 2, 3.0, 4.0, 5, 6, 7, 8, 9, 10, 11, 12, 13)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def messy(spark):
    long = words(99, 30_000)
    texts = [(1, "Hello World"), (2, "hello world"), (3, ""), (4, None), (None, "no id here"), (None, None), (5, long), (6, long), (7, "same row"), (7, "same row"), (8, "a\nb\nc\nd"), (9, "x\na\nb\nc\ny"), (10, " \t\n\n "), (11, "É ß ▁ 𓀀\x00 z"), (12, words(5, 80))]
    rows = [(i, t, None if i == 3 else "en", None if i in (1, 3) else f"s{(i or 0) % 3}", None, *EXTRA) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
