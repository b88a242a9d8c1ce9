"""The corpus pipeline: quality, repeated lines, near copies, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import checkpoint_dir, cut, documents
from corvane.llm.crf_quality import THRESHOLD, add_score, train
from corvane.llm.line_dedup import line_dedup
from corvane.llm.mixing import mix
from corvane.llm.simhash import near_duplicates
from corvane.llm.unigram import encode

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    model = train(docs, documents(spark, sf_dir, "labels"))
    return add_score(docs, model, out_col="__score").filter(F.col("__score") >= THRESHOLD).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages of three lines or more are removed from the texts; a text of which nothing is left goes."""
    out = line_dedup(docs, counts=("__lines", "__removed"))
    return out.filter((F.col("__removed") == 0) | (F.col("text") != "")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike (five words, similarity 0.8) one row with the smallest id stays; a document without an id stays.

    Rows are told apart by id and a hash of the text, so of an id that stands with several texts only those that are alike go; of equal rows one stays.
    """
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = near_duplicates(keyed, key_col="__key").filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id"), F.col("__key").alias("__gone")).agg(F.min("first").alias("__first"), F.count(F.lit(1)).alias("__n"))
    found = cut(rows.filter("not __first or __n > 1"), small=True)
    same = (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("__gone"))
    out = keyed.join(found, same, "left_anti")
    repeated = found.filter("__first")
    if not repeated.isEmpty():
        out = out.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__key"]))
    return out.select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as many times as the mix takes it: 0, 1 or 2."""
    return mix(docs, carry=True).withColumn("__copy", F.explode(F.expr("CASE WHEN __copies > 0 THEN sequence(1L, __copies) END"))).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding them gives the text again."""
    ids = encode(docs, check_col="round_trip")
    return ids.select("doc_id", "source", "lang", "n_chars", F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [("quality", quality_stage), ("lines", line_stage), ("simhash", simhash_stage), ("mix", mix_stage), ("tokens", token_stage)]
#: Training, the search for components and the Viterbi search are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared checkpoint folder and read again."""
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
