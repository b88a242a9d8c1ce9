"""Context compression, grounding checks and abstention."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import INFERENCE_INDICATORS, NO_INFO_PHRASES, bare_sentences, claims, contains_any, count_of, estimate_tokens, key_terms, mm_ss, tokens
from corvane.functions.vectors import cosine, hashed_embedding, hashed_embeddings


def sentence_score(sentence: Column, query_tokens: Column) -> Column:
    """Shared distinct terms over the query's; half as much again from three shared terms. ``query_tokens`` are distinct."""
    share = lambda n: F.when(F.size(query_tokens) == 0, 0.0).otherwise(n / F.size(query_tokens) * F.when(n > 2, 1.5).otherwise(1.0))
    return F.get(F.transform(F.array(F.size(F.array_intersect(query_tokens, tokens(sentence)))), share), F.lit(0))  # the count is bound, not worked out three times


def extractive_compress(pairs: DataFrame, query_col: str = "query", text_col: str = "text", keys: tuple = ("query_id", "id"), top: int = 5, digits: int = 6) -> DataFrame:
    """(keys, compressed, original_length, compressed_length): the best sentences of each text, best first; texts without any go.

    A text's sentences stay in its row: no shuffle. Texts go where nothing is left by way of the explode, so that nothing is worked out again for a filter.
    """
    scored = F.transform(bare_sentences(F.col(text_col)), lambda s, i: F.struct((-F.round(sentence_score(s, F.col("__q")), digits)).alias("s"), i.alias("i"), s.alias("t")))
    best = F.slice(F.array_sort(F.filter(scored, lambda x: x["s"] < 0)), 1, top)
    joined = F.transform(F.filter(F.array(best), lambda b: F.size(b) > 0), lambda b: F.array_join(F.transform(b, lambda x: x["t"]), " "))
    out = pairs.withColumn("__q", F.array_distinct(tokens(F.col(query_col)))).select("*", F.explode(joined).alias("compressed"))
    return out.select(*keys, "compressed", F.length(text_col).cast("long").alias("original_length"), F.length("compressed").cast("long").alias("compressed_length"))


def filter_compress(pairs: DataFrame, query_col: str = "query", text_col: str = "text", keys: tuple = ("query_id", "id"), top: int = 5, least: float = 0.3) -> DataFrame:
    """The same by the cosine of sentence and query embeddings, from ``least``."""
    rows = pairs.withColumn("__s", bare_sentences(F.col(text_col))).withColumns({"__q": hashed_embedding(F.col(query_col)), "__v": hashed_embeddings(F.col("__s"))})
    scored = F.transform("__v", lambda v, i: F.struct((-F.round(cosine(v, F.col("__q")), 6)).alias("s"), i.alias("i"), F.get(F.col("__s"), i).alias("t")))
    best = F.transform(F.slice(F.array_sort(F.filter(scored, lambda x: x["s"] <= -least)), 1, top), lambda x: x["t"])
    out = rows.withColumn("compressed", F.array_join(best, " "))
    return out.filter(F.col("compressed") != "").select(*keys, "compressed", F.length(text_col).cast("long").alias("original_length"), F.length("compressed").cast("long").alias("compressed_length"))


def hybrid_compress(pairs: DataFrame, query_col: str = "query", text_col: str = "text", keys: tuple = ("query_id", "id"), top: int = 5, least: float = 0.3) -> DataFrame:
    """Extractive, then by embedding; the query column stays at hand between the two."""
    first = extractive_compress(pairs, query_col, text_col, (*keys, query_col), top).withColumnRenamed("compressed", "__t")
    return filter_compress(first.drop("original_length", "compressed_length"), query_col, "__t", keys, top, least)


def generated_compress(pairs: DataFrame, generator, query_col: str = "query", text_col: str = "text", keys: tuple = ("query_id", "id"), least_words: int = 50) -> DataFrame:
    """The same by a generator's summaries of texts of ``least_words`` words and more; shorter texts, and those for which the generator fails, stay as they are."""
    ask = F.concat(F.lit("Summarise the passage; keep what bears on the question.\nQuestion: "), F.col(query_col), F.lit("\n\nPassage:\n"), F.col(text_col), F.lit("\n\nSummary:"))

    @F.pandas_udf("string")
    def said(prompts: pd.Series, texts: pd.Series) -> pd.Series:
        def one(prompt: str, text: str) -> str:
            if len((text or "").split()) < least_words:
                return text
            try:
                return generator.answer(prompt).strip()
            except Exception:  # noqa: BLE001  a provider's failure keeps the text
                return text

        return pd.Series([one(p, t) for p, t in zip(prompts, texts)], dtype=object)

    out = pairs.withColumn("compressed", said(ask, F.col(text_col)))
    return out.select(*keys, "compressed", F.length(text_col).cast("long").alias("original_length"), F.length("compressed").cast("long").alias("compressed_length"))


def compress(pairs: DataFrame, method: str = "extractive", generator=None, most: int | None = None, order: str = "rank", **options) -> DataFrame:
    """Compression by name: extractive, filter, hybrid, or llm, which without a generator is extractive, as is any other name. ``most`` keeps the first texts of each query by ``order``."""
    if most is not None:
        pairs = pairs.filter(F.col(order) <= most)
    if method == "llm" and generator is not None:
        return generated_compress(pairs, generator, **options)
    return {"filter": filter_compress, "hybrid": hybrid_compress}.get(method, extractive_compress)(pairs, **options)


def context_budget(ranked: DataFrame, most_tokens: int = 4000, group: str = "query_id", order: str = "rank", text_col: str = "text", start: str | None = None, end: str | None = None) -> DataFrame:
    """(group, context): numbered texts joined by blank lines until the estimated tokens reach the budget; the text that crosses it is cut and gets dots."""
    w = Window.partitionBy(group).orderBy(order)
    rows = ranked.withColumn("__n", F.row_number().over(w)).withColumn("__est", estimate_tokens(F.col(text_col)))
    rows = rows.withColumn("__before", F.coalesce(F.sum("__est").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("__before") < most_tokens)
    room = ((most_tokens - F.col("__before")) * 4).cast("int")
    text = F.when(F.col("__before") + F.col("__est") > most_tokens, F.concat(F.substring(F.col(text_col), F.lit(1), room), F.lit("..."))).otherwise(F.col(text_col))
    if start and end:
        stamp = F.when(F.col(start).isNotNull() & F.col(end).isNotNull(), F.concat(F.lit("["), mm_ss(F.col(start)), F.lit("-"), mm_ss(F.col(end)), F.lit("] "))).otherwise(F.lit(""))
        text = F.concat(stamp, text)
    line = F.concat(F.col("__n").cast("string"), F.lit(". "), text)
    return rows.withColumn("__line", line).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__line"))), lambda x: x["__line"]), "\n\n").alias("context"))


def claim_rows(df: DataFrame, answer: str = "answer", context: str = "context", keys: tuple = ("id",), digits: int = 6) -> DataFrame:
    """(keys, claim_no, claim, n_terms, n_found, coverage, grounded): a claim is grounded if half its key terms occur in the context."""
    ctx = F.lower(F.coalesce(F.col(context), F.lit("")))
    rows = df.select(*keys, ctx.alias("__ctx"), F.posexplode(claims(F.col(answer))).alias("claim_no", "claim")).withColumn("__terms", key_terms(F.col("claim")))
    n, found = F.size("__terms"), F.size(F.filter("__terms", lambda t: F.col("__ctx").contains(F.lower(t))))
    coverage = F.when(n == 0, 0.0).otherwise(found / n)
    return rows.select(*keys, "claim_no", "claim", n.cast("long").alias("n_terms"), found.cast("long").alias("n_found"), F.round(coverage, digits).alias("coverage"), ((n > 0) & (coverage >= 0.5)).alias("grounded"))


def retrieval_quality(hits: DataFrame, group: str = "query_id", score: str = "score", tie: str = "id", digits: int = 6) -> DataFrame:
    """(group, quality): mean score weighted by 1 / rank."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))
    r = hits.withColumn("__r", F.row_number().over(w))
    return r.groupBy(group).agg(F.round(F.sum(F.col(score) / F.col("__r")) / F.sum(1.0 / F.col("__r")), digits).alias("quality"))


def confidence(coverage: Column, retrieval: Column, indicators: Column, n_claims: Column) -> Column:
    penalty = F.least(F.lit(0.3), indicators * 0.1) + F.when(n_claims == 0, 0.3).when(n_claims > 10, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), coverage * 0.6 + retrieval * 0.4 - penalty))


def grounding_level(coverage: Column, conf: Column, ungrounded: Column) -> Column:
    return F.when((coverage >= 0.8) & (conf >= 0.7), "fully_grounded").when((coverage >= 0.5) | (conf >= 0.5), "partially_grounded").when((ungrounded > 3) | (conf < 0.3), "likely_hallucinated").otherwise("unverifiable")


def suggested_action(level: Column, abstain: Column, warnings: Column) -> Column:
    return F.when(abstain, "abstain").when(level == "fully_grounded", "accept").when((level == "partially_grounded") & warnings, "accept_with_warning").when(level == "partially_grounded", "accept").when(level == "likely_hallucinated", "reject").otherwise("manual_review")


def verify(df: DataFrame, answer: str = "answer", context: str = "context", retrieval: Column | None = None, keys: tuple = ("id",), abstain_below: float = 0.4, digits: int = 6) -> DataFrame:
    """One row per answer: claims, coverage, confidence, level, should_abstain, action.

    An answer that says there is no information is fully grounded with confidence 1. ``retrieval`` is the
    retrieval quality (0.5 if none is given). All in the row: no shuffle.
    """
    ctx = F.lower(F.coalesce(F.col(context), F.lit("")))
    ground = F.transform(claims(F.coalesce(F.col(answer), F.lit(""))), lambda c: (F.size(key_terms(c)) > 0) & (F.size(F.filter(key_terms(c), lambda t: F.col("__ctx").contains(F.lower(t)))) * 2 >= F.size(key_terms(c))))
    rows = df.withColumn("__ctx", ctx).withColumn("__g", ground)
    n, g = F.size("__g"), F.size(F.filter("__g", lambda x: x))
    coverage = F.when(n == 0, 0.0).otherwise(g / n)
    ind = count_of(F.col(answer), INFERENCE_INDICATORS)
    conf = confidence(coverage, retrieval if retrieval is not None else F.lit(0.5), ind, n)
    none = contains_any(F.col(answer), NO_INFO_PHRASES)
    out = rows.select(*keys, none.alias("no_info"), n.cast("long").alias("n_claims"), g.cast("long").alias("n_grounded"), ind.cast("long").alias("n_indicators"), F.when(none, 1.0).otherwise(F.round(coverage, digits)).alias("coverage"), F.when(none, 1.0).otherwise(F.round(conf, digits)).alias("confidence"))
    level = F.when(F.col("no_info"), "fully_grounded").otherwise(grounding_level(F.col("coverage"), F.col("confidence"), F.col("n_claims") - F.col("n_grounded")))
    out = out.withColumn("level", level).withColumn("should_abstain", ~F.col("no_info") & (F.col("confidence") < abstain_below))
    return out.withColumn("action", suggested_action(F.col("level"), F.col("should_abstain"), (F.col("n_grounded") < F.col("n_claims")) | (F.col("n_indicators") > 2)))


def abstention(queries: DataFrame, hits: DataFrame, least: float = 0.3, enough: int = 1, query_id: str = "query_id", score: str = "score", contexts: DataFrame | None = None, shortest: int = 50) -> DataFrame:
    """(query_id, n_hits, max_score, n_relevant, abstain, reason) for every query, hits or not. With ``contexts`` (query_id, context), a context that is not empty and shorter than ``shortest`` characters is too little, too."""
    agg = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.max(score).alias("max_score"), F.count_if(F.col(score) >= least).alias("n_relevant"))
    j = queries.select(F.col(query_id).alias("query_id")).distinct().join(agg, "query_id", "left")
    n, rel = F.coalesce("n_hits", F.lit(0)).cast("long"), F.coalesce("n_relevant", F.lit(0)).cast("long")
    short = F.lit(False)
    if contexts is not None:
        j = j.join(contexts.select("query_id", F.length("context").alias("__chars")), "query_id", "left")
        short = F.coalesce((F.col("__chars") > 0) & (F.col("__chars") < shortest), F.lit(False))
    reason = F.when(n == 0, "no_hits").when(F.col("max_score") < least, "low_similarity").when(rel < enough, "too_few_relevant").when(short, "short_context").otherwise("answer")
    return j.select("query_id", n.alias("n_hits"), F.col("max_score"), rel.alias("n_relevant"), (reason != "answer").alias("abstain"), reason.alias("reason"))


def format_context(hits: DataFrame, group: str = "query_id", order: str = "rank", text_col: str = "text", start: str | None = None, end: str | None = None, file: str | None = None) -> DataFrame:
    """(group, context): numbered texts, each with its file and times where it has times."""
    from corvane.functions.text import hh_mm_ss

    head = F.concat(F.col(order).cast("string"), F.lit(". "))
    if start and end:
        name = F.coalesce(F.col(file), F.lit("")) if file else F.lit("")
        stamp = F.concat(F.lit("["), name, F.lit(":"), hh_mm_ss(F.col(start)), F.lit("-"), hh_mm_ss(F.col(end)), F.lit("]\n"))
        head = F.concat(head, F.when(F.col(start).isNotNull() & F.col(end).isNotNull(), stamp).otherwise(""))
    line = F.concat(head, F.col(text_col), F.lit("\n"))
    return hits.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))


def format_sources(hits: DataFrame, group: str = "query_id", order: str = "rank", columns: tuple = ("id", "text", "score")) -> DataFrame:
    """(group, sources): the hits of each query as an array of structs in order; a query's hits are few."""
    return hits.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*columns).alias("s")))), lambda x: x["s"]).alias("sources"))
