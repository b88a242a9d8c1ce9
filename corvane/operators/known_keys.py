"""Bloom filters of known keys, kept beside a table: rows that are certainly new skip the join with it.

A filter is a series of generations, each made for a number of keys that was counted before and for a wanted rate of chance hits; adding keys appends a
generation of at least twice the last one's room, or fills the last one up while it has room. So filters grow with the data and their rate stays near the wanted one. Bitmaps are
built by Spark's bitmap aggregates in pieces of 32,768 bits.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Room of the first generation; bytes of a filter that is sent to all tasks at most: a larger one is not used, the join does all.
LEAST_KEYS, MOST_BYTES = 1 << 16, 64 << 20
PIECE = 32_768
SCHEMA = "generation int, room long, hashes int, bits long, filled long, piece long, map binary"


def shape(keys: int, rate: float) -> tuple[int, int]:
    """(bits, hash functions) of a filter for so many keys; bits fill whole pieces."""
    bits = math.ceil(keys * -math.log(rate) / math.log(2) ** 2)
    return -(-bits // PIECE) * PIECE, max(1, round(-math.log2(rate)))


def _places(key: Column, hashes: int, bits: int) -> Column:
    """The key's bits, from two hashes."""
    one, two = F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits - 1)) + 1
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(one + i * two, F.lit(bits)))


def _pieces(keys: DataFrame, hashes: int, bits: int) -> DataFrame:
    """(piece, map): bitmaps are put together in each task before the shuffle."""
    bit = keys.select(F.explode(_places(F.col("key"), hashes, bits)).alias("bit"))
    return bit.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("map"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The newest rows of a filter: of each generation the version of the most keys."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(f"{SCHEMA}, version string").parquet(path)
    newest = rows.groupBy("generation").agg(F.max_by("version", F.struct("filled", "version")).alias("v")).withColumnRenamed("generation", "g")
    return rows.join(F.broadcast(newest), (F.col("generation") == F.col("g")) & (F.col("version") == F.col("v"))).drop("g", "v", "version")


def add(spark: SparkSession, path: str, keys: DataFrame, column: str, rate: float = 0.01) -> None:
    """Put keys into the filter at ``path`` (made if it isn't there). Null keys are passed over; keys that are in it already only cost room."""
    new = keys.select(F.col(column).alias("key")).filter("key is not null").distinct()
    n = new.count()
    if not n:
        return
    old = read(spark, path)
    last = old.select("generation", "room", "hashes", "bits", "filled").distinct().orderBy(F.col("generation").desc()).first()
    if last is not None and last.filled + n <= last.room:
        generation, room, hashes, bits, filled = last.generation, last.room, last.hashes, last.bits, last.filled + n
        maps = _pieces(new, hashes, bits).unionByName(old.filter(F.col("generation") == generation).select("piece", "map")).groupBy("piece").agg(F.bitmap_or_agg("map").alias("map"))
    else:
        generation, room = (0, max(LEAST_KEYS, n)) if last is None else (last.generation + 1, max(2 * last.room, n))
        bits, hashes = shape(room, rate / 2 ** (generation + 1))  # rates of all generations add up to less than the wanted one
        filled, maps = n, _pieces(new, hashes, bits)
    row = maps.select(F.lit(generation).alias("generation"), F.lit(room).cast("long").alias("room"), F.lit(hashes).alias("hashes"), F.lit(bits).cast("long").alias("bits"), F.lit(filled).cast("long").alias("filled"), "piece", "map")
    row.write.mode("overwrite").parquet(f"{path}/version={uuid.uuid4().hex}")


def maybe_known(df: DataFrame, path: str, column: str, flag: str = "__maybe") -> DataFrame | None:
    """Adds whether a key may be in the filter: false is certain. None if the filter is larger than MOST_BYTES, whose size is read first. Null keys are not in it."""
    spark = df.sparkSession
    rows = read(spark, path)
    shapes = rows.select("generation", "hashes", "bits").distinct().orderBy("generation").collect()  # one for each doubling
    if sum(s.bits for s in shapes) // 8 > MOST_BYTES:
        return None
    maps = []
    for s in shapes:
        whole = np.zeros(s.bits // 8, np.uint8)
        for r in rows.filter(F.col("generation") == s.generation).select("piece", "map").toLocalIterator():
            whole[(r.piece - 1) * (PIECE // 8) : r.piece * (PIECE // 8)] = np.frombuffer(bytes(r.map), np.uint8)
        maps.append(whole)
    shared = spark.sparkContext.broadcast(maps)
    names, kinds = df.columns, df.schema
    from pyspark.sql import types as T

    places = [F.when(F.col(column).isNotNull(), _places(F.col(column), s.hashes, s.bits)).alias(f"__g{i}") for i, s in enumerate(shapes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.zeros(b.num_rows, bool)
            for i, bits in enumerate(shared.value):
                lists = b.column(len(names) + i)
                n = lists.fill_null([]).value_lengths().to_numpy(zero_copy_only=False)
                at = lists.fill_null([]).flatten().to_numpy(zero_copy_only=False)
                on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
                missing = np.bincount(np.repeat(np.arange(b.num_rows), n), weights=1 - on, minlength=b.num_rows)
                found |= (missing == 0) & (n > 0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(found)], [*names, flag])

    return df.select(*[F.col(f"`{c}`") for c in names], *places).mapInArrow(run, T.StructType([*kinds.fields, T.StructField(flag, T.BooleanType())]))


def unknown(df: DataFrame, known: DataFrame, path: str, column: str, known_column: str | None = None) -> DataFrame:
    """The rows of ``df`` whose key ``known`` lacks, as a left anti join gives them; only rows that the filter at ``path`` can't rule out are shuffled.

    Every key of ``known`` must have been added to the filter. Null keys are unknown, repeated rows stay, the input is read twice.
    """
    have = known.select(F.col(known_column or column).alias("__known"))
    flagged = maybe_known(df, path, column)
    if flagged is None:
        return df.join(have, F.col(column) == F.col("__known"), "left_anti")
    parts = [flagged.filter("not __maybe"), flagged.filter("__maybe").join(have, F.col(column) == F.col("__known"), "left_anti")]
    return reduce(DataFrame.unionByName, parts).drop("__maybe")
