"""BM25 over a postings table, query expansion and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.sources.tables import cut

K1, B = 1.5, 0.75
#: Rows (query, token) that are broadcast at most: some 20 MB.
BROADCAST_TERMS = 200_000

# Heads and synonyms for query expansion, in order.
SYNONYMS = [
    ("la gi", ["la cai gi", "nghia la gi", "duoc hieu nhu the nao"]),
    ("nhu the nao", ["ra sao", "bang cach nao", "lam sao"]),
    ("tai sao", ["vi sao", "ly do gi", "nguyen nhan gi"]),
    ("khi nao", ["luc nao", "thoi diem nao", "bao gio"]),
    ("o dau", ["tai dau", "vi tri nao", "cho nao"]),
    ("ai", ["tri tue nhan tao", "artificial intelligence"]),
    ("cai gi", ["dieu gi", "thu gi", "vat gi"]),
    ("bao nhieu", ["so luong bao nhieu", "may", "bao lau"]),
    ("ml", ["machine learning", "hoc may"]),
    ("nlp", ["xu ly ngon ngu tu nhien", "natural language processing"]),
    ("deep learning", ["hoc sau", "mang neural sau"]),
    ("what is", ["define", "explain", "describe"]),
    ("how", ["in what way", "by what means"]),
    ("why", ["for what reason", "what causes"]),
    ("when", ["at what time", "what date"]),
    ("where", ["in what place", "at what location"]),
    ("who", ["which person", "what individual"]),
]
# Fixed values end.


def counted_tokens(toks: Column) -> Column:
    """An array of tokens to an array of (token, tf), by one sort and one pass; no document leaves its row."""
    runs = lambda t: F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
    pairs = lambda t, r: F.transform(r, lambda i, k: F.struct(F.get(t, i).alias("token"), (F.coalesce(F.get(r, k + 1), F.size(t)) - i).cast("long").alias("tf")))
    bound = F.transform(F.array(F.array_sort(toks)), lambda t: F.get(F.transform(F.array(runs(t)), lambda r: pairs(t, r)), F.lit(0)))
    return F.when(F.size(toks) > 0, F.get(bound, F.lit(0)))


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, len, token, tf, first): a document's tokens, counted in its row; first marks one row of each document, which has a null token if it has none."""
    t = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("toks"))
    t = t.select("id", F.size("toks").cast("long").alias("len"), F.posexplode_outer(counted_tokens(F.col("toks"))).alias("pos", "p"))
    return t.select("id", "len", F.col("p.token").alias("token"), F.col("p.tf").alias("tf"), F.coalesce(F.col("pos") == 0, F.lit(True)).alias("first"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, len, token, tf): the index; len is the document's number of tokens. Tokens are counted inside each row, so no text is shuffled."""
    return _counted(docs, id_col, text_col).filter("token is not null").drop("first")


def corpus_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: n documents, their average length in tokens (documents without tokens count)."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens(F.coalesce(F.col(text_col), F.lit("")))).cast("double")).alias("avgdl"))


def query_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(index, stats) for the tokens of some queries: one pass over the texts, whose counts of these tokens are dealt by id and kept in the shared folder.

    Up to BROADCAST_TERMS distinct tokens, counted first, are broadcast; more are joined.
    """
    wanted = terms.select("token").distinct()
    few = F.broadcast if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else (lambda x: x)
    rows = _counted(docs, id_col, text_col).join(few(wanted.select(F.col("token").alias("w"))), F.col("token") == F.col("w"), "left").filter("w is not null or first")
    kept = cut(rows.select("id", "len", F.col("w").alias("token"), "tf", "first").repartition("id"))
    stats = kept.agg(F.count_if("first").alias("n"), (F.sum(F.when(F.col("first"), F.col("len"))) / F.count_if("first")).alias("avgdl"))
    return kept.filter("token is not null").drop("first"), stats


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, df): documents that hold each token. Tokens are made distinct inside each row, so that counting needs no order."""
    return docs.select(F.explode(F.array_distinct(tokens(F.coalesce(F.col(text_col), F.lit(""))))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def bm25_idf(index: DataFrame, stats: DataFrame) -> DataFrame:
    """(token, df, idf): idf = ln((n - df + 0.5) / (df + 0.5) + 1). ``index``: postings, or (token, df)."""
    df = index if "df" in index.columns else index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(stats.select("n"))).select("token", "df", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, token, qf): a token written twice counts twice."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(tokens(F.col(text_col))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qf"))


def bm25_scores(index: DataFrame, stats: DataFrame, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score) for documents that share a token with the query.

    Up to BROADCAST_TERMS query tokens, counted first, are broadcast with their idf, so an index dealt by id stays so and its
    sums need no shuffle; beyond that the index is joined on the token.
    """
    few = F.broadcast if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else (lambda x: x)
    wanted = terms.select("token").distinct()
    idf = bm25_idf(index.join(wanted, "token", "left_semi"), stats).select("token", "idf")
    weights = terms.join(idf, "token").select("query_id", "token", (F.col("qf") * F.col("idf")).alias("weight"))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + F.lit(k1) * (1 - b + F.lit(b) * F.col("len") / F.col("avgdl")))
    frequencies = index.crossJoin(F.broadcast(stats.select("avgdl"))).select("token", "id", tf.alias("f"))
    return frequencies.join(few(weights), "token").groupBy("query_id", "id").agg(F.sum(F.col("f") * F.col("weight")).alias("score"))


def top_k(scored: DataFrame, k: int, score: str = "score", group: str = "query_id", tie: str = "id") -> DataFrame:
    """The k best of each group with their rank; ties go to the smaller id. Each task keeps k rows of a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_col: str = "query", digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank), scores over 0 only, rounded before ranking."""
    terms = query_terms(queries, query_id, query_col)
    scored = bm25_scores(*query_index(docs, terms, id_col, text_col), terms)
    return top_k(scored.withColumn("score", F.round("score", digits)).filter("score > 0"), k)


def expand_synonyms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query", expansions: int = 3, whole_words: bool = False) -> DataFrame:
    """(query_id, position, variant): the query itself, then lower-cased variants in which one head is replaced by one synonym.

    Duplicates keep their first place; at most ``expansions`` + 1 variants. Heads match anywhere in the text unless ``whole_words``.
    """
    q, low = F.col(text_col), F.lower(F.col(text_col))

    def variants(head: str, synonyms: list[str]) -> Column:
        here = low.rlike(rf"(?U)\b{head}\b") if whole_words else low.contains(head)
        swap = (lambda s: F.regexp_replace(low, rf"(?U)\b{head}\b", s)) if whole_words else (lambda s: F.replace(low, F.lit(head), F.lit(s)))
        return F.when(here, F.array(*[swap(s) for s in synonyms[:expansions]])).otherwise(F.array().cast("array<string>"))

    every = F.concat(F.array(q), *[variants(h, s) for h, s in SYNONYMS])
    return queries.select(F.col(id_col).alias("query_id"), F.posexplode(F.slice(F.array_distinct(every), 1, expansions + 1)).alias("position", "variant"))


def feedback_terms(ranked: DataFrame, docs: DataFrame, terms: DataFrame, top: int = 3, count: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, place, token, freq): the most frequent tokens of over three characters in each query's first documents, query terms excluded; ties go to the first seen."""
    best = ranked.filter(F.col("rank") <= top).select("query_id", "id", "rank")
    seen = best.join(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "id").select("query_id", "rank", F.posexplode(tokens(F.col("t"))).alias("pos", "token")).filter(F.length("token") > 3)
    fresh = seen.join(terms.select("query_id", "token").distinct(), ["query_id", "token"], "left_anti")
    freq = fresh.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("freq"), F.min(F.struct("rank", "pos")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.col("freq").desc(), "first")
    return freq.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= count).select("query_id", "place", "token", "freq")


def expand_feedback(queries: DataFrame, terms: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, query): the query with its feedback terms appended in order."""
    added = terms.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]), " ").alias("added"))
    return queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("q")).join(added, "query_id", "left").select("query_id", F.concat("q", F.lit(" "), F.coalesce("added", F.lit(""))).alias("query"))
