import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corvane.streaming import embedding_cache as E

HOUR = 3600
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(hours):
    return (START + dt.timedelta(hours=hours)).isoformat()


def replay(events, keep):
    """By the definition, over all events in order of time, entries first: outcomes of requests and the entries that are live at the end."""
    out, entry, asked = [], {}, {}
    for t, key, vector in sorted(events, key=lambda e: (e[0], e[2] is None)):
        if vector is not None:
            entry[key] = (t, vector)
            asked.pop(key, None)
        elif key in entry and entry[key][0] <= t < entry[key][0] + keep:
            out.append((key, t, "hit", tuple(entry[key][1])))
        elif t < asked.get(key, -1):
            out.append((key, t, "waiting", None))
        else:
            out.append((key, t, "miss", None))
            asked[key] = t + keep
    return sorted(out, key=repr)


def put(folder, name, events):
    (folder / f"{name}.json").write_text("\n".join(json.dumps({"key": k, "at": at(t), "embedding": v}) for t, k, v in events))


@pytest.fixture
def state(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    E.settings(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_restarts_lose_nothing_and_entries_expire(spark, tmp_path, state):
    source = tmp_path / "in"
    source.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        s = E.cached(spark.readStream.schema(E.EVENT).json(str(source)), keep_seconds=10 * HOUR, late="1 hour")
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    parts = [
        [(1, "a", None), (1, "a", None), (2, "b", None), (2, "c", [3.0])],
        [(3, "a", [1.0, 2.0]), (3, "a", None), (3, "b", None), (4, "c", None)],  # after a restart: the entry serves, b waits, c is still there
        [(12, "a", None), (12, "b", None), (12, "c", None), (13.5, "a", None)],  # c has expired at 12, b's question too, a at 13
        [(40, "z", None)],
        [(41, "a", [9.0]), (42, "a", None), (60, "a", None)],
    ]
    every = []
    for i, events in enumerate(parts):
        put(source, i, events)
        every += events
        run()
    got = [(r.key, (r.at.replace(tzinfo=dt.timezone.utc) - START).total_seconds() / HOUR, r.outcome, None if r.embedding is None else tuple(r.embedding)) for r in spark.read.parquet(out).select("key", F.col("at"), "outcome", "embedding").collect()]
    assert sorted(got, key=repr) == sorted(((k, float(t), o, v) for k, t, o, v in replay(every, 10)), key=repr)
    left = spark.read.format("statestore").option("stateVarName", "entry").load(checkpoint).select("key.key", "value.*").collect()
    assert [(r.key, list(r.embedding)) for r in left if r.until > 60 * HOUR * 1000 + START.timestamp() * 1000] == []
    assert {r.key for r in left} <= {"a"}  # the expired ones are gone


def test_two_tiers(spark, tmp_path, state):
    source, tier, out, checkpoint = tmp_path / "in", str(tmp_path / "tier"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    ask = lambda name, rows: (source / f"{name}.json").write_text("\n".join(json.dumps({"key": k, "at": at(t), "text": x}) for t, k, x in rows))
    embed = lambda df: df.withColumn("embedding", F.array(F.length("text").cast("double")))

    def run():
        requests = spark.readStream.schema("key string, at timestamp, text string").json(str(source))
        E.serve(requests, tier, out, checkpoint, embed, keep_seconds=10 * HOUR, late="3 hours").awaitTermination()
        return sorted((r.key, r.at.replace(tzinfo=dt.timezone.utc).isoformat(), r.outcome, list(r.embedding) if r.embedding else None) for r in spark.read.parquet(out).collect())

    ask(1, [(1, "a", "text"), (1.5, "a", "text"), (1, "b", "other")])
    assert [(k, o, v) for k, _, o, v in run()] == [("a", "new", [4.0]), ("a", "waiting", None), ("b", "new", [5.0])]
    run()  # entries reach the state with the next batch
    ask(2, [(2, "a", "text"), (3, "c", "new one")])
    got = run()
    assert ("a", at(2), "hit", [4.0]) in got and ("c", at(3), "new", [7.0]) in got and len(got) == 5
    ask(3, [(30, "a", "text")])
    assert ("a", at(30), "new", [4.0]) in run() and spark.read.parquet(tier).filter("key = 'a'").count() == 2
