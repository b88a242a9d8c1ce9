"""Retrieval metrics over hits and relevance judgements, evaluation of answers, parameter search."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.metrics import bleu, exact_match, f1


def retrieval_metrics(hits: DataFrame, qrels: DataFrame, ks: tuple = (1, 3, 5, 10), keys: tuple = ("query_id",), digits: int = 6) -> DataFrame:
    """Long form (keys, k, precision, recall, rr, ndcg, hit), for every query that has judgements.

    hits (keys, id, rank); qrels (query_id, id[, rel]). precision divides by k even if fewer were found;
    recall and hits count distinct ids; the ideal order is that of all judged ids; no relevant id gives 0.
    """
    rel = qrels if "rel" in qrels.columns else qrels.withColumn("rel", F.lit(1.0))
    n_rel = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    judged = hits.join(rel.select("query_id", "id", "rel"), ["query_id", "id"], "left")
    ideal = rel.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "id"))).filter(F.col("r") <= max(ks))
    ideal = ideal.groupBy("query_id").agg(*[F.sum(F.when(F.col("r") <= k, F.col("rel") / F.log2(F.col("r") + 1))).alias(f"i{k}") for k in ks])
    return _metrics(hits, judged, n_rel.join(ideal, "query_id", "left"), ks, keys, digits)


def label_metrics(hits: DataFrame, queries: DataFrame, points: DataFrame, ks: tuple = (1, 3, 5, 10), keys: tuple = ("query_id",), digits: int = 6, id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """:func:`retrieval_metrics` where the points of a query's label, but for those of its own id, are its judgements.

    These pairs, of which there are as many as the squares of the labels' sizes, are counted by label; only those of the hits become rows.
    """
    q, p = (x.select(F.col(id_col).alias(i), F.col(label).alias(n)) for x, i, n in ((queries, "query_id", "its"), (points, "id", "label")))
    same = p.groupBy("label").agg(F.count(F.lit(1)).alias("all"))
    own = p.groupBy("id", "label").agg(F.count(F.lit(1)).alias("own")).withColumnsRenamed({"id": "i", "label": "l"})
    counted = q.join(same, F.col("its") == F.col("label")).join(own, (F.col("query_id") == F.col("i")) & (F.col("its") == F.col("l")), "left")
    n_rel = counted.groupBy("query_id").agg(F.sum(F.col("all") - F.coalesce("own", F.lit(0))).alias("n_rel")).filter("n_rel > 0")
    gain = [0.0, *itertools.accumulate(1 / math.log2(r + 1) for r in range(1, max(ks) + 1))]
    ideal = n_rel.select("query_id", "n_rel", *[F.element_at(F.array(*map(F.lit, gain)), (F.least(F.lit(k), F.col("n_rel")) + 1).cast("int")).alias(f"i{k}") for k in ks])
    rel = hits.select("query_id", "id").distinct().join(q, "query_id").join(p, "id").filter((F.col("its") == F.col("label")) & (F.col("query_id") != F.col("id"))).select("query_id", "id", F.lit(1.0).alias("rel"))
    return _metrics(hits, hits.join(rel, ["query_id", "id"], "left"), ideal, ks, keys, digits)


def _metrics(hits: DataFrame, judged: DataFrame, queries: DataFrame, ks: tuple, keys: tuple, digits: int) -> DataFrame:
    """judged: the hits with rel; queries (query_id, n_rel, and for each k the gain of the ideal order)."""
    others = [k for k in keys if k != "query_id"]
    base = queries if not others else queries.crossJoin(F.broadcast(hits.select(*others).distinct()))
    judged = judged.withColumn("rel", F.coalesce("rel", F.lit(0.0)))
    one = lambda k: F.when((F.col("rank") <= k) & (F.col("rel") > 0), 1)
    per = judged.groupBy(*keys).agg(
        F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"),
        *[x for k in ks for x in (F.sum(one(k)).alias(f"h{k}"), F.count_distinct(F.when((F.col("rank") <= k) & (F.col("rel") > 0), F.col("id"))).alias(f"u{k}"), F.sum(F.when(F.col("rank") <= k, F.col("rel") / F.log2(F.col("rank") + 1))).alias(f"d{k}"))],
    )
    j = base.join(per, list(keys), "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).cast("long").alias("k"), F.round(z(f"h{k}") / k, digits).alias("precision"), F.round(z(f"u{k}") / F.col("n_rel"), digits).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), digits).alias("rr"), F.round(F.when(z(f"i{k}") > 0, z(f"d{k}") / z(f"i{k}")).otherwise(0.0), digits).alias("ndcg"), (z(f"h{k}") > 0).cast("double").alias("hit"))
        for k in ks
    ]))
    return j.select(*keys, rows.alias("m")).select(*keys, "m.*")


def average_metrics(metrics: DataFrame, by: tuple = ("k",), digits: int = 6) -> DataFrame:
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), digits).alias(c) for c in ("precision", "recall", "rr", "ndcg", "hit")])


def best_method(averages: DataFrame, method: str = "method", score: str = "rr") -> DataFrame:
    """The method of the largest score; ties go to the first name."""
    return averages.orderBy(F.col(score).desc(), method).limit(1).select(F.col(method).alias("best"), F.col(score).alias("best_score"))


def answer_metrics(df: DataFrame, prediction: str = "prediction", truth: str = "truth", digits: int = 6) -> DataFrame:
    p, t = F.col(prediction), F.col(truth)
    return df.withColumns({"exact_match": exact_match(p, t), "f1": F.round(f1(p, t), digits), "bleu": F.round(bleu(p, t), digits)})


def grounding_confusion(df: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """(expected, actual, n, correct): counts of pairs of levels, compared without case."""
    e, a = F.lower(expected), F.lower(actual)
    return df.groupBy(e.alias("expected"), a.alias("actual")).agg(F.count(F.lit(1)).alias("n")).withColumn("correct", F.col("expected") == F.col("actual"))


def speech_speed(df: DataFrame, audio: str = "audio_seconds", took: str = "took_seconds", engine: str = "engine", digits: int = 6) -> DataFrame:
    """(engine, mean_rtf, total_rtf, speed_up): real-time factors of transcription runs."""
    return df.groupBy(engine).agg(F.round(F.avg(F.when(F.col(audio) > 0, F.col(took) / F.col(audio))), digits).alias("mean_rtf"), F.round(F.sum(took) / F.nullif(F.sum(audio), F.lit(0.0)), digits).alias("total_rtf"), F.round(F.sum(audio) / F.nullif(F.sum(took), F.lit(0.0)), digits).alias("speed_up"))


def parameter_grid(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """All combinations, one row each, with config_id in order of the names' values."""
    names = list(grid)
    return spark.createDataFrame([(i, *c) for i, c in enumerate(itertools.product(*grid.values()))], ["config_id", *names])


def tuning_score(mrr: Column, ndcg: Column, f1_: Column, semantic: Column) -> Column:
    return 0.3 * mrr + 0.3 * ndcg + 0.2 * f1_ + 0.2 * semantic


def generated_queries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = 50) -> DataFrame:
    """(id, query): the first sentence, of 21 to 150 characters, of texts of at least 50; ``most`` of them, the smallest ids, or all."""
    q = F.substring(F.substring_index(text_col, ".", 1), 1, 150)
    out = docs.filter(F.length(text_col) >= 50).select(F.col(id_col).alias("id"), F.trim(q).alias("query")).filter(F.length("query") > 20)
    return out if most is None else out.orderBy("id").limit(most)


def semantic_similarity(df: DataFrame, prediction: str = "prediction", truth: str = "truth", digits: int = 6) -> DataFrame:
    """Adds semantic: the cosine of the two embeddings."""
    from corvane.functions.vectors import cosine, hashed_embedding

    return df.withColumns({"__p": hashed_embedding(F.col(prediction)), "__t": hashed_embedding(F.col(truth))}).withColumn("semantic", F.round(cosine(F.col("__p"), F.col("__t")), digits)).drop("__p", "__t")


def random_configurations(spark: SparkSession, grid: dict[str, list], count: int, seed: int = 0) -> DataFrame:
    """``count`` different combinations of the grid, the same for the same seed."""
    full = parameter_grid(spark, grid)
    return full.orderBy(F.xxhash64("config_id", F.lit(seed)), "config_id").limit(count)


def accuracy(confusion: DataFrame) -> DataFrame:
    """(n, n_correct, accuracy) of a confusion table."""
    return confusion.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("correct"), F.col("n"))), F.lit(0)).alias("n_correct")).withColumn("accuracy", F.when(F.col("n") > 0, F.round(F.col("n_correct") / F.col("n"), 6)))
