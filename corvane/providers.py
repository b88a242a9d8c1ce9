"""Providers of what needs a model: embedding, reranking, generation, correction, speech.

The defaults are small, deterministic stand-ins. Their scores are not comparable to those of real models.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.chunking import pack_lines


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def answer(self, prompt: str) -> str: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Corrector(Protocol):
    def correct(self, text: str) -> str: ...


class Transcriber(Protocol):
    def transcribe(self, audio: bytes) -> dict: ...


class IdentityCorrector:
    def correct(self, text: str) -> str:
        return text


#: What models of the E5 family want before queries and passages.
PREFIXES = {"e5": ("query: ", "passage: ")}


def model_prefix(model: str, query: bool) -> str:
    return PREFIXES["e5"][0 if query else 1] if "e5" in model.lower() else ""


def embed_column(df: DataFrame, provider: Embedder, text_col: str = "text", out_col: str = "embedding", prefix: str = "", batch: int = 100, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """Embeddings by any provider on Arrow batches; the provider is made once and travels with the task.

    It gets ``batch`` texts at a time, and after a failure the same again, ``retries`` times in all, waiting ``wait`` seconds, then twice as long each time; the last failure is the task's.
    """

    def ask(texts: list[str]) -> list[list[float]]:
        for attempt in range(retries):
            try:
                return provider.embed(texts)
            except Exception:
                if attempt == retries - 1:
                    raise
                time.sleep(wait * 2**attempt)
        raise ValueError("retries must be 1 or more")

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            given = [prefix + (t or "") for t in texts]
            yield pd.Series([list(map(float, v)) for at in range(0, len(given), batch) for v in ask(given[at : at + batch])], dtype=object)

    return df.withColumn(out_col, run(F.col(text_col)))


def embed_cached(df: DataFrame, cache: DataFrame, provider: Embedder, model: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with embeddings, new cache entries): each distinct text that the cache (key, embedding) lacks is embedded once."""
    from corvane.operators.registry import cache_key, cache_misses

    keyed = df.withColumn("key", cache_key(F.lit("provider"), F.lit(model), F.col(text_col)))
    fresh = embed_column(cache_misses(keyed.select("key", text_col).dropDuplicates(["key"]), cache), provider, text_col).select("key", "embedding")
    return keyed.join(cache.select("key", "embedding").unionByName(fresh), "key", "left"), fresh


def rerank_column(df: DataFrame, provider: Reranker, query_col: str = "query", text_col: str = "text", out_col: str = "new_score") -> DataFrame:
    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([float(provider.score(q, [t])[0]) for q, t in zip(queries, texts)], dtype=float)

    return df.withColumn(out_col, run(F.col(query_col), F.col(text_col)))


def reply_column(prompts: Column, generator: Generator, failed: str = "") -> Column:
    """A generator's replies on Arrow batches; ``failed`` where it raises."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        def one(p: str) -> str:
            try:
                return generator.answer(p)
            except Exception:  # noqa: BLE001  a failure is a reply of its own
                return failed

        return batch.map(one)

    return run(prompts)


def generated_scores(df: DataFrame, generator: Generator, query_col: str = "query", text_col: str = "text", out_col: str = "new_score") -> DataFrame:
    """Reranking scores 0 to 1 by a generator asked for a number from 0 to 10, on the first 500 characters; 0.5 where it gives none or fails."""
    ask = F.concat(F.lit("Rate from 0 to 10 how well the document answers the query. Reply with the number only.\nQuery: "), F.col(query_col), F.lit("\nDocument: "), F.substring(text_col, 1, 500), F.lit("\nRating:"))
    return df.withColumn(out_col, reply_score(reply_column(ask, generator)))


def rephrased(queries: DataFrame, generator: Generator, id_col: str = "query_id", text_col: str = "query", expansions: int = 3, angles: bool = False) -> DataFrame:
    """(query_id, position, variant): the query itself, then the generator's lines: the same question in other words, or, with ``angles``, related questions. A generator that fails leaves the query alone; with ``angles`` the synonyms' variants."""
    from corvane.operators.lexical import expand_synonyms

    what = f"Write {expansions} related questions that look at this one from different angles" if angles else f"Write this question in {expansions} other ways that mean the same"
    ask = F.concat(F.lit(f"{what}, one a line, without numbers.\nQuestion: "), F.col(text_col))
    rows = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("q"), reply_lines(reply_column(ask, generator), expansions).alias("lines"))
    out = rows.select("query_id", F.posexplode(F.concat(F.array("q"), "lines")).alias("position", "variant"))
    if not angles:
        return out
    silent = rows.filter(F.size("lines") == 0).select("query_id", F.col("q").alias("query"))
    return out.join(silent, "query_id", "left_anti").unionByName(expand_synonyms(silent, expansions=expansions))


def reply_score(reply: Column) -> Column:
    """The first number of a model's reply over ten, within 0..1; 0.5 without a number."""
    n = F.nullif(F.regexp_extract(reply, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double") / 10
    return F.when(n.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))


def reply_lines(reply: Column, most: int) -> Column:
    """The lines of a model's reply as queries: numbering and marks at their start go, empty ones too."""
    lines = F.transform(F.split(reply, "\n"), lambda x: F.trim(F.ltrim(F.trim(x), F.lit("0123456789.-) *"))))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, most)


def correct_column(df: DataFrame, provider: Corrector | None = None, text_col: str = "text", kind: str = "extraction_type", out_col: str = "corrected", most: int = 1500) -> DataFrame:
    """Correction of indirectly extracted texts, piece by piece of ``most`` characters, pieces joined by newlines; a piece that fails stays as it is. Direct texts stay."""
    provider = provider or IdentityCorrector()

    def one(text: str) -> str:
        out = []
        for piece in pack_lines(text, most):
            try:
                out.append(provider.correct(piece))
            except Exception:  # noqa: BLE001  a provider's failure keeps the original
                out.append(piece)
        return "\n".join(out)

    @F.pandas_udf("string")
    def run(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([one(t) if t and k == "indirect" else t for t, k in zip(texts, kinds)], dtype=object)

    return df.withColumn(out_col, run(F.col(text_col), F.col(kind)))


# Embedding models by alias, with their dimensions, for the catalogue only.
MODELS = {
    "hash": 64, "sbert": 768, "sbert-mini": 384, "minilm": 384, "mpnet": 768, "e5": 768, "e5-base": 768, "e5-large": 1024, "e5-small": 384, "vi-sbert": 768, "vi-encoder": 768,
}
# Fixed values end.


def models() -> dict[str, int]:
    return dict(MODELS)


def register_model(name: str, dimensions: int) -> None:
    MODELS[name] = dimensions
