"""Vector collections as Parquet tables: create, append, scan, count, drop, payload rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.registry import point_id

#: Kinds that a payload keeps as they are; others become text.
KEPT = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.ArrayType)


def coerce_payload(df: DataFrame, keep: tuple = ()) -> DataFrame:
    """Strings, numbers, booleans and lists stay; structs and maps become JSON text, all else its string form."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in keep or isinstance(f.dataType, KEPT):
            out.append(c)
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            out.append(F.to_json(c).alias(f.name))
        else:
            out.append(c.cast("string").alias(f.name))
    return df.select(*out)


def append_points(chunks: DataFrame, path: str, doc_col: str = "doc_id", index_col: str = "chunk_index", id_col: str | None = None) -> None:
    """Append chunks with an id: a given column, or md5 of document and index, so a repeated append gives the same ids."""
    pid = F.col(id_col).cast("string") if id_col else point_id(F.col(doc_col), F.col(index_col))
    coerce_payload(chunks.withColumn("point_id", pid)).write.mode("append").parquet(path)


def collection(spark: SparkSession, path: str) -> DataFrame:
    """The points; of points with one id any one (appends of one id hold the same content)."""
    return spark.read.parquet(path).dropDuplicates(["point_id"])


def get_point(points: DataFrame, point: str) -> DataFrame:
    return points.filter(F.col("point_id") == point)


def collection_stats(points: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """One row: points, vectors, dimensions."""
    return points.agg(F.count(F.lit(1)).alias("points"), F.count(vector_col).alias("vectors"), F.max(F.size(vector_col)).alias("dimensions"))


def create_collection(spark: SparkSession, name: str, schema: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({schema}) USING PARQUET")


def drop_collection(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def update_payload(points: DataFrame, point_ids: list[str], changes: dict) -> DataFrame:
    """Set columns of the given points."""
    hit = F.col("point_id").isin(point_ids)
    return points.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) if k in points.columns else F.when(hit, F.lit(v)) for k, v in changes.items()})
