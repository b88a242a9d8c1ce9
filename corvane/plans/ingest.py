"""The ingest job: files to registry, processed texts, chunks and embeddings; rebuilding the index runs the same steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import providers
from corvane.operators import chunking, registry, search
from corvane.sources import collections, files


def process(found: DataFrame, corrector: providers.Corrector | None = None) -> DataFrame:
    """Extract and correct: one row a file; failures are rows with success = false."""
    return providers.correct_column(files.extract(found), corrector, "content")


def index(processed: DataFrame, method: str = "sentence", size: int = 500, overlap: int = 50, embedder: providers.Embedder | None = None) -> DataFrame:
    """Chunks with embeddings of all processed texts (id, corrected)."""
    chunks = chunking.chunk(processed.filter("success"), method, size, overlap, "id", "corrected")
    return providers.embed_column(chunks, embedder, "chunk") if embedder else search.embed(chunks, "chunk")


def add_folder(spark: SparkSession, folder: str, store: str, tags: list[str] | None = None, as_of: str | None = None, method: str = "sentence") -> dict[str, DataFrame]:
    """Read a folder into a store of three tables (registry, processed, points); files whose content is known are passed over.

    Each table is appended once, processed texts and points before the registry: a job that dies leaves files unregistered. Running it again appends to each table only
    what it lacks, by content and by point, so nothing stands twice.
    """
    accepted, rejected = files.validated(files.scan_folder(spark, folder))
    known = _read(spark, f"{store}/registry")
    new, duplicates = registry.fresh_documents(accepted, known.select("file_hash", "id") if known is not None else None)
    ids = new.select(registry.document_id(F.col("file_hash")).alias("id"))
    there = lambda name: (lambda df: ids.limit(0) if df is None else df.select("id").distinct())(_read(spark, f"{store}/{name}"))  # noqa: E731  Parquet appends of one job appear whole or not at all
    process(new).withColumn("id", registry.document_id(F.col("file_hash"))).join(there("processed"), "id", "left_anti").write.mode("append").parquet(f"{store}/processed")
    stored = spark.read.parquet(f"{store}/processed").join(ids, "id", "left_semi")
    collections.append_points(index(stored.join(there("points"), "id", "left_anti"), method), f"{store}/points", "id")
    counts = spark.read.parquet(f"{store}/points").groupBy("id").agg(F.count(F.lit(1)).alias("chunk_count"))
    when = F.lit(as_of).cast("timestamp") if as_of else F.col("modificationTime")
    rows = new.select("path", "file_hash", F.col("length").alias("file_size"), F.col("extension").alias("file_type"), F.col("folder").alias("category"), when.alias("uploaded_at")).join(stored.select("file_hash", "id", "success", "error"), "file_hash").join(counts, "id", "left")
    rows.withColumns({"filename": F.element_at(F.split("path", "/"), -1), "status": F.when(F.col("success"), "processed").otherwise("failed"), "tags": F.array(*[F.lit(t) for t in tags or []]).cast("array<string>"), "metadata": F.create_map().cast("map<string,string>"), "chunk_count": F.coalesce("chunk_count", F.lit(0))}).write.mode("append").parquet(f"{store}/registry")
    return {"registry": spark.read.parquet(f"{store}/registry"), "duplicates": duplicates, "rejected": rejected}


def rebuild(spark: SparkSession, store: str, target: str, method: str = "sentence", size: int = 500, overlap: int = 50) -> DataFrame:
    """The points of all processed texts anew, into another folder."""
    collections.append_points(index(spark.read.parquet(f"{store}/processed"), method, size, overlap), target, "id")
    return collections.collection(spark, target)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(path) if there else None
