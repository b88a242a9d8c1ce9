"""The registered queries of the corpus operators: thin, whole-table, production parameters.

Each takes every row of its table; what it does with nulls, ties, repeated rows, empty tables and other columns is said in the docstring of the operator it calls: none fails on
them, none carries columns of the table but the id, and rows that repeat an id are rows of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.alignment import alignment_digest
from corvane.llm.common import documents
from corvane.llm.crf_quality import quality
from corvane.llm.exact_dedup import exact_dedup
from corvane.llm.hard_negatives import hard_negatives, relabelled
from corvane.llm.html_extract import extract
from corvane.llm.license_scan import LICENSE_SQL, scan
from corvane.llm.line_dedup import LINE_DEDUP_SQL, line_dedup
from corvane.llm.mixing import mix
from corvane.llm.secret_scan import secret_digest
from corvane.llm.simhash import simhash_components
from corvane.llm.substring_dedup import substring_dedup
from corvane.llm.telephony import describe, store_text
from corvane.llm.unigram import token_digest


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="max")


OP1_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir, spread=True))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op4_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir, spread=True), documents(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir, spread=True))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir, spread=True))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages", spread=True))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(documents(spark, sf_dir, spread=True))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return line_dedup(d.select("doc_id", "text").na.fill("", ["text"])).select("doc_id", "n_lines", "n_removed", "text")


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(store_text(documents(spark, sf_dir, spread=True))).withColumnRenamed("id", "doc_id")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(documents(spark, sf_dir, spread=True))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digest(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(documents(spark, sf_dir, "embeddings")))


OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS label, c.vec_id AS id, c.label AS other, list_dot_product(a.v, c.v)::BIGINT AS score FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE other = label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE other <> label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_substring_dedup, op3_mix_sources, op4_crf_quality, op5_simhash, op6_license_scan, op7_html_text, op8_sentencepiece, op9_line_dedup, op10_telephony, op11_secret_scan, op12_token_alignment, op13_hard_negatives)}
SQL = {"op1_exact_dedup": OP1_SQL, "op6_license_scan": LICENSE_SQL, "op9_line_dedup": LINE_DEDUP_SQL, "op13_hard_negatives": OP13_SQL}
