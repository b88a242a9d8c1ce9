"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.tables import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only where a local session names none, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvane-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, small: bool = False) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder.

    ``small`` is for tables of counts, edges and states, which take few bytes: they are written by one task for each core of the cluster, not one for each shuffle partition."""
    checkpoint_dir(df.sparkSession)
    return (df.coalesce(max(2, df.sparkSession.sparkContext.defaultParallelism)) if small else df).checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder. Unlike a checkpoint, the table read again holds on to nothing, so that :func:`release` can let go of the shuffle files it came from."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files whose tables nothing refers to any more: Spark removes them once the driver collects what refers to them. Only disk is saved."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While jobs run in here, Arrow batches have at most so many rows: the default, 10,000, takes tens of MB a task, twice, where rows are texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
        yield
    finally:
        spark.conf.set(key, before)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents", spread: bool = False) -> DataFrame:
    return table(spark, sf_dir, name, spread)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of the filter on ids: its size is fixed (2 MB), it only saves work.
FILTER_BITS = 1 << 24


def taking_part(df: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t): ids and UTF-8 texts of the rows whose id may stand in ``ids`` (one column, id).

    A bitmap of fixed size over hashes of the ids drops nearly all other rows before any shuffle; those that pass by chance
    find no partner in the join that follows.
    """
    spark = df.sparkSession
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    wanted = ids.select("id").distinct().withColumn("bit", bit)
    maps = wanted.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("m")).collect()
    bits = np.zeros(FILTER_BITS // 8 + 8192, np.uint8)
    for r in maps:
        bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.m), np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2).to_numpy()
            b = b.filter(pa.array((shared.value[at >> 3] >> (at & 7)) & 1, pa.uint8()).cast(pa.bool_()))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["id", "t"])

    plain = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t")).filter("id is not null and t is not null").withColumn("bit", bit)
    return plain.mapInArrow(run, "id long, t binary")
