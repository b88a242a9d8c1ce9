"""Evaluation plans: all cases of all methods in one job."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import evaluation, lexical, search
from corvane.plans import rag


def methods(k: int = 10, alpha: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Callable[[DataFrame, DataFrame], DataFrame]]:
    """Retrieval methods by name: (docs, questions) to hits (query_id, id, score, rank)."""

    def vector(docs: DataFrame, q: DataFrame) -> DataFrame:
        return search.knn(search.embed(docs.select(id_col, text_col), text_col), search.embed(q, "question"), k, id_col=id_col, query_id="query_id")

    def bm25(docs: DataFrame, q: DataFrame) -> DataFrame:
        return lexical.bm25_topk(docs, q, k, id_col, text_col, "query_id", "question")

    return {"vector": vector, "bm25": bm25, "hybrid": lambda d, q: rag.retrieve(d, q, k, alpha, id_col, text_col)}


def evaluate_retrieval(docs: DataFrame, questions: DataFrame, qrels: DataFrame, ks: tuple = (1, 3, 5, 10), which: dict | None = None) -> DataFrame:
    """(method, k, n, precision, recall, rr, ndcg, hit): averages over all questions with judgements."""
    parts = [f(docs, questions).select("query_id", "id", "rank", F.lit(name).alias("method")) for name, f in (which or methods(max(ks))).items()]
    hits = reduce(DataFrame.unionByName, parts)
    return evaluation.average_metrics(evaluation.retrieval_metrics(hits, qrels, ks, ("method", "query_id")), ("method", "k"))


def evaluate_answers(docs: DataFrame, cases: DataFrame, **options) -> DataFrame:
    """cases (query_id, question, truth) to one row each with answer and exact match, F1, BLEU and semantic similarity."""
    said = rag.answer(docs, cases.select("query_id", "question"), **options).select("query_id", F.col("answer").alias("prediction"), "level")
    return evaluation.semantic_similarity(evaluation.answer_metrics(said.join(cases.select("query_id", "truth"), "query_id")))


def end_to_end(docs: DataFrame, cases: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """One row: mean reciprocal rank, NDCG, F1, semantic similarity and the score that parameter search ranks by."""
    r = evaluate_retrieval(docs, cases.select("query_id", "question"), qrels, (k,), {"hybrid": methods(k)["hybrid"]}).select(F.col("rr").alias("mrr"), "ndcg")
    a = evaluate_answers(docs, cases, k=k).agg(F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("semantic"), 6).alias("semantic"))
    return r.crossJoin(F.broadcast(a)).withColumn("score", F.round(evaluation.tuning_score(F.col("mrr"), F.col("ndcg"), F.col("f1"), F.col("semantic")), 6))
