"""An embedding cache as streaming state: hits from state, each miss told once, entries that expire by event time, a Parquet folder as second tier.

Events are (key, at, embedding): a request has no embedding, an entry has one. Entries are read from the second tier as a stream of files, so what is
written there reaches the state with the next batch; a restart goes on from the checkpoint and loses neither entries nor what was asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

EVENT = "key string, at timestamp, embedding array<double>"
ANSWER = "key string, at timestamp, outcome string, embedding array<double>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class EmbeddingCache(StatefulProcessor):
    """State of a key: its newest entry (embedding, from, until) and when a miss was told that no entry has answered yet."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "embedding array<double>, start long, until long")
        self.asked = handle.getValueState("asked", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True)
        # in order of time; at one time entries come before requests, so the order of arrival within a batch doesn't matter
        events["ms"] = events["at"].map(lambda t: int(t.timestamp() * 1000))
        events["request"] = events["embedding"].map(lambda v: v is None)
        out = []
        entry, asked = self.entry.get() if self.entry.exists() else None, self.asked.get()[0] if self.asked.exists() else -1
        for at, ms, request, embedding in events.sort_values(["ms", "request"], kind="stable")[["at", "ms", "request", "embedding"]].itertuples(index=False):
            if not request:
                if entry is None or ms >= entry[1]:
                    entry, asked = (list(map(float, embedding)), ms, ms + self.keep_ms), -1
            elif entry is not None and entry[1] <= ms < entry[2]:
                out.append((key[0], at, "hit", entry[0]))
            else:
                out.append((key[0], at, "waiting" if ms < asked else "miss", None))
                asked = asked if ms < asked else ms + self.keep_ms
        for state, value, until in ((self.entry, entry, entry and entry[2]), (self.asked, (asked,) if asked >= 0 else None, asked)):
            if value is not None:
                state.update(value)
                self.handle.registerTimer(int(until))
            elif state.exists():
                state.clear()
        yield pd.DataFrame(out, columns=["key", "at", "outcome", "embedding"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.entry.exists() and self.entry.get()[2] <= now:
            self.entry.clear()
        if self.asked.exists() and self.asked.get()[0] <= now:
            self.asked.clear()
        yield pd.DataFrame([], columns=["key", "at", "outcome", "embedding"])

    def close(self) -> None:
        pass


def cached(events: DataFrame, keep_seconds: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """(key, at, outcome, embedding): hit, miss, or waiting (a miss that was told before and has no entry yet) for each request of a stream of events.

    An entry serves requests from its time until ``keep_seconds`` later, the newest entry counts. State goes when the watermark passes that time; rows older than the
    watermark are dropped. Null keys are a key. The session needs the RocksDB state store, see :func:`settings`.
    """
    keyed = events.select("key", "at", "embedding").withWatermark("at", late)
    return keyed.groupBy("key").transformWithStateInPandas(EmbeddingCache(keep_seconds * 1000), outputStructType=ANSWER, outputMode="append", timeMode="eventTime")


def settings(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def serve(requests: DataFrame, tier: str, out: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame], keep_seconds: int = 86_400, late: str = "10 minutes") -> StreamingQuery:
    """Answer a stream of requests (key, at, text) into folder ``out``: (key, at, outcome, embedding) with outcome hit, disk, new or waiting.

    Misses are looked up in the second tier, where entries of the last ``keep_seconds`` count (disk); ``embed`` (key, text to key, text, embedding) makes
    the rest, once a key (new), which is written to the second tier. Each batch writes folders of its own, over what a failed run of the same batch left. Runs what is there,
    then stops; a later run goes on from the checkpoint. The text of a key is its first by order. An entry has the time of its request and comes with the next batch: ``late`` must cover
    the time between two batches, or the state doesn't take it and the second tier answers.
    """
    spark = requests.sparkSession
    settings(spark)
    for folder in (tier, out):  # a stream of files needs its folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    # the text travels in the key, so that a miss can be embedded when it is told
    asked = requests.select(F.to_json(F.struct("key", "text")).alias("key"), "at", F.lit(None).cast("array<double>").alias("embedding"))
    known = tier_stream(spark, tier)
    answers = cached(asked.unionByName(known), keep_seconds, late)

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.withColumns({"text": F.get_json_object("key", "$.text"), "key": F.get_json_object("key", "$.key")}).persist()
        try:
            misses = rows.filter("outcome = 'miss'")
            disk = spark.read.schema("key string, at timestamp, text string, embedding array<double>, batch long").parquet(tier).filter(F.col("batch") < number)
            disk = disk.select(F.col("key").alias("dk"), F.col("at").alias("dat"), F.col("embedding").alias("de"))
            near = misses.join(disk, (F.col("key") == F.col("dk")) & (F.col("dat") <= F.col("at")) & (F.col("at").cast("double") - F.col("dat").cast("double") < keep_seconds))
            old = near.groupBy("key", "at").agg(F.max_by("de", "dat").alias("embedding")).withColumn("outcome", F.lit("disk"))
            lacking = misses.join(old.select(F.col("key").alias("ok"), F.col("at").alias("oat")), F.col("key").eqNullSafe(F.col("ok")) & (F.col("at") == F.col("oat")), "left_anti")
            wanted = lacking.groupBy("key").agg(F.min("text").alias("text"), F.min("at").alias("at"))
            made = embed(wanted.select("key", "text")).select(F.col("key").alias("mk"), "embedding")
            fresh = wanted.join(made, F.col("key").eqNullSafe(F.col("mk"))).select("key", "at", "text", "embedding")
            fresh.write.mode("overwrite").parquet(f"{tier}/batch={number}")
            fresh = spark.read.schema("key string, at timestamp, text string, embedding array<double>").parquet(f"{tier}/batch={number}").select(F.col("key").alias("fk"), F.col("embedding").alias("fe"))
            new = lacking.select("key", "at").join(fresh, F.col("key").eqNullSafe(F.col("fk"))).select("key", "at", F.col("fe").alias("embedding"), F.lit("new").alias("outcome"))
            rest = rows.filter("outcome <> 'miss'").select("key", "at", "embedding", "outcome")
            rest.unionByName(old).unionByName(new).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            rows.unpersist()

    return answers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tier_stream(spark: SparkSession, tier: str) -> DataFrame:
    """The second tier's entries as events, keyed as serve() keys requests."""
    stream = spark.readStream.schema("key string, at timestamp, text string, embedding array<double>").option("recursiveFileLookup", "true").parquet(tier)
    return stream.select(F.to_json(F.struct("key", "text")).alias("key"), "at", "embedding")
