import random

import pytest

from corvane.functions import table_functions as TF
from corvane.operators import chunking


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 9)))
    made = [" ".join(word() + rng.choice(["", "", "", ".", "!", "?", "\n"]) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    return [*enumerate(made), (100, None), (101, ""), (102, "   "), (103, "x" * 3000)]


@pytest.mark.parametrize("method", ["sentence", "recursive", "fixed", "offset"])
def test_same_chunks_as_the_columns(spark, method):
    TF.register(spark)
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    got = spark.sql(f"SELECT doc_id, c.* FROM {{docs}} d, LATERAL chunk_text(d.text, '{method}', 300, 30) AS c", docs=docs)
    want = chunking.chunk(docs, method, 300, 30)
    key = lambda df: sorted((r.doc_id, r.chunk_index, r.chunk, r.char_count) for r in df.collect())
    assert key(got) == key(want) and ("start" in got.columns) == (method == "offset")
    assert key(TF.chunked(docs, method, 300, 30)) == key(want)


def test_lines_and_short_parts(spark):
    TF.register(spark)
    docs = spark.createDataFrame([(1, "One. Two.\nThree is longer. Four.")], "doc_id long, text string")
    ask = lambda more: [r.chunk for r in spark.sql(f"SELECT c.* FROM {{docs}} d, LATERAL chunk_text(d.text, 'lines', {more}) AS c", docs=docs).collect()]
    assert ask("12, 0") == ["One. Two.", "Three is longer.", "Four."] or ask("12, 0") == chunking.pack_lines("One. Two.\nThree is longer. Four.", 12)
    assert all(len(c) >= 15 for c in ask("12, 0, 15")[:-1])


def test_wrong_arguments_are_told_before_a_query_runs(spark):
    TF.register(spark)
    for call in ("chunk_text('a b', 'nothing')", "chunk_text('a b', 'sentence', 10, 10)", "chunk_text('a b', 'sentence', 0, 0)", "pack_segments(TABLE(SELECT 1 AS text))"):
        with pytest.raises(Exception, match="must be|lacks"):
            spark.sql(f"SELECT * FROM {call}")


def test_packed_segments_equal_the_gathered_ones(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice(["", None, "word " * rng.randint(1, 60), "short"]), float(i), i + 0.5) for k in ("a", "b", None) for i in range(80)]
    df = spark.createDataFrame(rows, "audio_file string, id int, text string, start double, end double").repartition(5)
    got = sorted(((r.audio_file, r.chunk_index, r.text, r.start_time, r.end_time, r.char_count, r.duration, r.word_count) for r in TF.packed(df, ["audio_file"], ["id"], 200, 20).collect()), key=repr)
    want = []
    for k in ("a", "b", None):
        for i, c in enumerate(chunking.pack_segments([{"text": t, "start": s, "end": e, "id": n} for f, n, t, s, e in rows if f == k], 200, 20)):
            want.append((k, i, c["text"], c["start_time"], c["end_time"], c["char_count"], c["duration"], c["word_count"]))
    assert got == sorted(want, key=repr)
    assert TF.packed(df.limit(0), ["audio_file"], ["id"]).count() == 0
