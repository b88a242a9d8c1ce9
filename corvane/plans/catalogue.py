"""The registered queries, each over its whole tables, and the SQL that an independent engine answers them with."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import metrics as M
from corvane.functions import text as T
from corvane.operators import answers, chunking, evaluation, lexical, lexical_index, ordered, search, vector_index
from corvane.sources.tables import checkpoint_dir, cut
from corvane.sources.tables import table as _table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Queries of the searches: every row whose id is divisible by this, against all rows. metrics_by_k and rerank_embedding take all rows as queries.
EVERY = 20
K = 10


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TOK = r"[\p{L}\p{N}_]+"
_BM25 = rf"""
toks AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '{_TOK}') AS t FROM documents),
n AS (SELECT count(*) AS n, avg(len(t)::DOUBLE) AS avgdl FROM toks),
post AS (SELECT id, len, token, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS token FROM toks) GROUP BY ALL),
idf AS (SELECT token, count(*) AS df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM post, n GROUP BY token),
qt AS (SELECT query_id, token, count(*) AS qf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_TOK}')) AS token FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, id, round(sum(idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl)) * qf), 6) AS score FROM qt JOIN post USING (token) JOIN idf USING (token), n GROUP BY ALL)
"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, q = _table(spark, sf_dir, "documents", spread=True), _table(spark, sf_dir, "benchmark")
    terms = lexical.query_terms(q, "item_id", "text")
    return lexical.bm25_scores(*lexical.query_index(docs, terms), terms).withColumn("score", F.round("score", 6)).filter("score > 0")


def _index(spark: SparkSession, sf_dir: str) -> lexical_index.Index:
    """An index of the documents, in the shared folder."""
    path = f"{checkpoint_dir(spark)}/lexical-{uuid.uuid4().hex}"
    lexical_index.build(_table(spark, sf_dir, "documents"), path)
    return lexical_index.Index(spark, path)


@_query(f"WITH {_BM25} SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm WHERE score > 0) WHERE rank <= {K}")
def bm25_topk(spark, sf_dir):
    return lexical.top_k(_bm25(spark, sf_dir), K).withColumn("rank", F.col("rank").cast("long"))


@_query(SQL["bm25_topk"])
def bm25_index_topk(spark, sf_dir):
    hits, _ = lexical_index.search(_index(spark, sf_dir), _table(spark, sf_dir, "benchmark"), K, "item_id", "text")
    return hits.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@_query(f"WITH {_BM25} SELECT token, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", spread=True)
    return lexical.bm25_idf(lexical.document_frequencies(docs), docs.agg(F.count(F.lit(1)).alias("n"))).withColumn("idf", F.round("idf", 6))


@_query(rf"""SELECT lang, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM
 (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS token FROM documents) GROUP BY ALL)) WHERE rank <= 10""")
def term_freq_by_lang(spark, sf_dir):
    n = _table(spark, sf_dir, "documents", spread=True).select("lang", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), "token")
    return n.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 10")


_PAIRS = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, p.vec_id AS id, q.label AS ql, p.label AS pl, list_dot_product(q.v, p.v) AS d, sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(p.v, p.v)) AS nn, list_distance(q.v, p.v) AS l2 FROM e q, e p WHERE q.vec_id % 20 = 0)
"""
_ALL_PAIRS = _PAIRS.replace(" WHERE q.vec_id % 20 = 0", "")
_METRIC = {"cosine": "CASE WHEN nn = 0 THEN 0 ELSE d / nn END", "dot": "d", "euclid": "-l2"}


def _knn_sql(metric: str, k: int, where: str = "true", score: str | None = None) -> str:
    return f"(SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round({score or _METRIC[metric]}, 6) + 0.0 AS score FROM pairs WHERE {where}) QUALIFY rank <= {k})"


def _knn(spark, sf_dir, k=K, metric="cosine", every=EVERY, **kw):
    p = _table(spark, sf_dir, "embeddings")
    return search.knn(p, p if every == 1 else p.filter(F.col("vec_id") % every == 0), k, metric, **kw).withColumn("rank", F.col("rank").cast("long"))


@_query(f"WITH {_PAIRS} SELECT * FROM {_knn_sql('cosine', K)}")
def vector_knn_cosine(spark, sf_dir):
    return _knn(spark, sf_dir)


@_query(f"WITH {_PAIRS} SELECT * FROM {_knn_sql('dot', K)}")
def vector_knn_dot(spark, sf_dir):
    return _knn(spark, sf_dir, metric="dot")


@_query(f"WITH {_PAIRS} SELECT * FROM {_knn_sql('euclid', K, 'query_id <> id')}")
def vector_knn_euclid(spark, sf_dir):
    return _knn(spark, sf_dir, metric="euclid", exclude_self=True)


@_query(f"WITH {_PAIRS} SELECT query_id, id, score, rank FROM {_knn_sql('cosine', K, 'pl BETWEEN 3 AND 5 AND round(' + _METRIC['cosine'] + ', 6) >= 0.1')}")
def vector_knn_filtered(spark, sf_dir):
    p = _table(spark, sf_dir, "embeddings")
    kept = search.payload_filter(p, {"label": {"gte": 3, "lte": 5}})
    return search.knn(kept, p.filter(F.col("vec_id") % EVERY == 0), K, threshold=0.1).withColumn("rank", F.col("rank").cast("long"))


@_query(f"WITH {_PAIRS} SELECT * FROM {_knn_sql('cosine', 5)}")
def mmr_compat(spark, sf_dir):
    return search.mmr_compat(_knn(spark, sf_dir, 20), 5)


def _mmr_sql(k: int, weight: float = 0.5) -> str:
    """Each step picks the row of the largest gain among those that are left; written out step by step."""
    steps = ["p1 AS (SELECT query_id, id, score, 1 AS rank FROM h WHERE rank = 1)"]
    for i in range(2, k + 1):
        done = " UNION ALL ".join(f"SELECT query_id, id FROM p{j}" for j in range(1, i))
        steps.append(f"""p{i} AS (SELECT h.query_id, h.id, any_value(h.score) AS score, {i} AS rank FROM h JOIN ({done}) c ON h.query_id = c.query_id JOIN u x ON x.id = h.id JOIN u y ON y.id = c.id
  WHERE (h.query_id, h.id) NOT IN (SELECT (query_id, id) FROM ({done})) GROUP BY h.query_id, h.id
  QUALIFY row_number() OVER (PARTITION BY h.query_id ORDER BY {weight} * any_value(h.score) - (1 - {weight}) * max(list_dot_product(x.v, y.v)) DESC, any_value(h.score) DESC, h.id) = 1)""")
    every = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, k + 1))
    return f"WITH {_PAIRS}, h AS {_knn_sql('cosine', 20)}, u AS (SELECT vec_id AS id, list_transform(v, lambda z: z / sqrt(list_dot_product(v, v))) AS v FROM e), {', '.join(steps)} SELECT query_id, id, score, rank::INTEGER AS rank FROM ({every})"


@_query(_mmr_sql(5))
def mmr_diverse(spark, sf_dir):
    return search.true_mmr(_knn(spark, sf_dir, 20), _table(spark, sf_dir, "embeddings"), 5)


@_query()
def vector_knn_lsh(spark, sf_dir):
    p = _table(spark, sf_dir, "embeddings")
    return search.knn_lsh(p, p.filter(F.col("vec_id") % EVERY == 0), K)


def _ann(spark, sf_dir):
    """Approximate neighbours by an index of all embeddings, in the shared folder."""
    p, path = _table(spark, sf_dir, "embeddings"), f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    vector_index.build(p, path, payload=("label",))
    return vector_index.search(vector_index.VectorIndex(spark, path), p, p.filter(F.col("vec_id") % EVERY == 0), K)


@_query()
def vector_knn_ann(spark, sf_dir):
    return _ann(spark, sf_dir)


@_query()
def vector_ann_recall(spark, sf_dir):
    """One row: how many of the exact neighbours the index finds, and the shares of all rows whose codes and whole vectors a query meets."""
    found, n = cut(_ann(spark, sf_dir), small=True), _table(spark, sf_dir, "embeddings").count()
    both = _knn(spark, sf_dir).select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    shares = found.groupBy("query_id").agg(F.first("scanned").alias("s"), F.first("compared").alias("c")).agg((F.avg("s") / n).alias("scanned"), (F.avg("c") / n).alias("compared"))
    return both.agg(F.count_distinct("query_id").alias("n_queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall")).crossJoin(F.broadcast(shares))


_EMB = rf"""
dtok AS (SELECT id, 'd' AS kind, unnest(t) AS token FROM toks UNION ALL SELECT item_id, 'q', unnest(regexp_extract_all(lower(coalesce(text, '')), '{_TOK}')) FROM benchmark),
tb AS (SELECT token, ('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS b, CASE WHEN substr(md5(token), 9, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM (SELECT DISTINCT token FROM dtok)),
comp AS (SELECT kind, id, b, sum(s) AS x FROM dtok JOIN tb USING (token) GROUP BY ALL),
norms AS (SELECT kind, id, sqrt(sum(x * x)) AS nn FROM comp GROUP BY ALL),
vec AS (SELECT q.id AS query_id, d.id AS id, round(CASE WHEN any_value(nq.nn) * any_value(nd.nn) = 0 THEN 0 ELSE sum(q.x * d.x) / (any_value(nq.nn) * any_value(nd.nn)) END, 6) AS vs FROM comp q JOIN comp d ON q.b = d.b AND q.kind = 'q' AND d.kind = 'd' JOIN norms nq ON nq.kind = 'q' AND nq.id = q.id JOIN norms nd ON nd.kind = 'd' AND nd.id = d.id GROUP BY q.id, d.id),
vtop AS (SELECT query_id, id, vs FROM vec QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY vs DESC, id) <= {2 * K}),
lex AS (SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) AS ls FROM bm WHERE score > 0),
hy AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.id, l.id) AS id, round(coalesce(vs, 0), 6) AS vector_score, round(coalesce(ls, 0), 6) AS bm25_score, round(0.7 * coalesce(vs, 0) + (1 - 0.7) * coalesce(ls, 0), 6) AS score FROM vtop v FULL JOIN lex l ON v.query_id = l.query_id AND v.id = l.id)
"""


@_query(f"WITH {_BM25}, {_EMB} SELECT query_id, id, vector_score, bm25_score, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hy) WHERE rank <= {K}")
def hybrid_search(spark, sf_dir):
    docs = search.embed(_table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"))
    q = search.embed(_table(spark, sf_dir, "benchmark"))
    near = search.knn(docs, q, 2 * K, id_col="doc_id", query_id="item_id")
    return search.hybrid(near, _bm25(spark, sf_dir), K, alpha=0.7).withColumn("rank", F.col("rank").cast("long"))


_LISTS = f"""lists AS (SELECT 'cosine' AS list_id, * FROM {_knn_sql('cosine', K)} UNION ALL SELECT 'euclid', * FROM {_knn_sql('euclid', K)} UNION ALL SELECT 'dot', * FROM {_knn_sql('dot', K)})"""


def _lists(spark, sf_dir):
    return reduce(DataFrame.unionByName, [_knn(spark, sf_dir, metric=m).withColumn("list_id", F.lit(m)) for m in ("cosine", "euclid", "dot")])


@_query(f"WITH {_PAIRS}, {_LISTS} SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(1.0 / (60 + rank)::DOUBLE), 6) AS score FROM lists GROUP BY ALL)) WHERE rank <= {K}")
def rrf_fusion(spark, sf_dir):
    return search.reciprocal_rank_fusion(_lists(spark, sf_dir), K).withColumn("rank", F.col("rank").cast("long"))


@_query(f"WITH {_PAIRS}, {_LISTS} SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(avg(score), 6) AS score FROM lists GROUP BY ALL)) WHERE rank <= {K}")
def score_fusion(spark, sf_dir):
    return search.score_fusion(_lists(spark, sf_dir), K).withColumn("rank", F.col("rank").cast("long"))


@_query(f"WITH {_ALL_PAIRS}, c AS {_knn_sql('euclid', 20)}, s AS (SELECT c.query_id, c.id, c.score AS original, round({_METRIC['cosine']}, 6) AS score FROM c JOIN pairs USING (query_id, id)) SELECT query_id, id, score, original, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5")
def rerank_embedding(spark, sf_dir):
    p = _table(spark, sf_dir, "embeddings")
    hits = _knn(spark, sf_dir, 20, "euclid", every=1)
    new = search.embedding_rerank_scores(hits, p, p, "vec_id", "embedding", "vec_id", "embedding")
    return search.rerank(hits, new, 5).withColumn("rank", F.col("rank").cast("long"))


def _synonym_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [f"CASE WHEN contains(lower(text), {q(h)}) THEN [{', '.join(f'replace(lower(text), {q(h)}, {q(x)})' for x in xs[:3])}] ELSE [] END" for h, xs in lexical.SYNONYMS]
    every = "[text]" + "".join(f" || {p}" for p in parts)
    return f"""WITH v AS (SELECT conv_id, turn, {every} AS a FROM conversations WHERE text IS NOT NULL),
x AS (SELECT conv_id, turn, unnest(a) AS variant, generate_subscripts(a, 1) AS i FROM v),
d AS (SELECT conv_id, turn, variant, min(i) AS i FROM x GROUP BY ALL)
SELECT conv_id || ':' || turn AS query_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS position, variant FROM d QUALIFY position <= 3"""


@_query(_synonym_sql())
def query_expand_synonym(spark, sf_dir):
    q = _table(spark, sf_dir, "conversations").filter("text is not null").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("query"))
    return lexical.expand_synonyms(q).withColumn("position", F.col("position").cast("long"))


@_query(rf"""WITH {_BM25}, top3 AS (SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm WHERE score > 0) WHERE rank <= 3),
s AS (SELECT query_id, rank, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM top3 JOIN toks USING (id)),
f AS (SELECT query_id, token, count(*) AS freq, min((rank, pos)) AS first FROM s WHERE length(token) > 3 AND (query_id, token) NOT IN (SELECT (query_id, token) FROM qt) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY freq DESC, first) AS place, token, freq FROM f QUALIFY place <= 5""")
def prf_terms(spark, sf_dir):
    docs, q = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    out = lexical.feedback_terms(lexical.top_k(_bm25(spark, sf_dir), 3), docs, lexical.query_terms(q, "item_id", "text"))
    return out.withColumn("place", F.col("place").cast("long"))


_REL = "qrels AS (SELECT q.vec_id AS query_id, p.vec_id AS id FROM embeddings q JOIN embeddings p ON q.label = p.label AND q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0), nr AS (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY 1)"
_ALL_REL = _REL.replace(" WHERE q.vec_id % 20 = 0", "")


def _metric_sql(hits: str, keys: str = "query_id", ks=(1, 3, 5, 10)) -> str:
    """hits: a table (method, query_id, id, rank)."""
    return f"""
 j AS (SELECT h.*, (r.id IS NOT NULL)::INT AS rel FROM {hits} h LEFT JOIN qrels r USING (query_id, id)),
 ms AS (SELECT DISTINCT method FROM {hits}),
 base AS (SELECT method, query_id, n_rel FROM nr, ms),
 ks AS (SELECT unnest([{', '.join(map(str, ks))}])::BIGINT AS k),
 m AS (SELECT b.method, b.query_id, k, round(coalesce(sum(rel) FILTER (rank <= k), 0)::DOUBLE / k, 6) AS precision,
   round(coalesce(count(DISTINCT id) FILTER (rank <= k AND rel = 1), 0)::DOUBLE / any_value(n_rel), 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank) FILTER (rel = 1), 0), 6) AS rr,
   round(coalesce(sum(rel / log2(rank + 1)) FILTER (rank <= k), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least(k, any_value(n_rel))) t(i)), 6) AS ndcg,
   (coalesce(sum(rel) FILTER (rank <= k), 0) > 0)::INT::DOUBLE AS hit
   FROM base b CROSS JOIN ks LEFT JOIN j ON j.query_id = b.query_id AND j.method = b.method GROUP BY b.method, b.query_id, k)"""


def _methods_sql() -> str:
    return "hits AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM {_knn_sql(m, K, 'query_id <> id')}" for m in ("cosine", "dot", "euclid")) + ")"


def _method_metrics(spark, sf_dir, every=EVERY):
    hits = None
    for m in ("cosine", "dot", "euclid"):
        h = _knn(spark, sf_dir, metric=m, every=every, exclude_self=True).withColumn("method", F.lit(m))
        hits = h if hits is None else hits.unionByName(h)
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return evaluation.label_metrics(cut(hits), e if every == 1 else e.filter(F.col("vec_id") % every == 0), e, keys=("method", "query_id"))


@_query(f"WITH {_PAIRS}, {_REL}, {_methods_sql()}, {_metric_sql('hits')} SELECT * FROM m")
def retrieval_metrics(spark, sf_dir):
    return _method_metrics(spark, sf_dir)


_AVG = "SELECT method, k, count(*) AS n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg, round(avg(hit), 6) AS hit FROM m GROUP BY ALL"


@_query(f"WITH {_ALL_PAIRS}, {_ALL_REL}, {_methods_sql()}, {_metric_sql('hits')} {_AVG}")
def metrics_by_k(spark, sf_dir):
    return evaluation.average_metrics(_method_metrics(spark, sf_dir, every=1), ("method", "k"))


@_query(f"WITH {_PAIRS}, {_REL}, {_methods_sql()}, {_metric_sql('hits')}, a AS ({_AVG}) SELECT method AS best, rr AS best_score FROM a WHERE k = 10 ORDER BY rr DESC, method LIMIT 1")
def best_method(spark, sf_dir):
    return evaluation.best_method(evaluation.average_metrics(_method_metrics(spark, sf_dir), ("method", "k")).filter("k = 10"))


_QA = """qa AS (SELECT conv_id, turn, coalesce(text, '') AS p, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS t, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations),
tk AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(lower(p), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS p, list_filter(string_split(trim(regexp_replace(lower(t), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM qa WHERE nx IS NOT NULL)""".replace("\\\\", "\\")


def _qa(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("prediction"), F.coalesce(F.lead("text").over(w), F.lit("")).alias("truth"), F.lead("turn").over(w).alias("nx")).filter("nx is not null")


@_query(f"""WITH {_QA}, s AS (SELECT conv_id, turn, array_to_string(p, ' ') = array_to_string(t, ' ') AS em, len(list_distinct(p)) AS np, len(list_distinct(t)) AS nt, len(list_intersect(list_distinct(p), list_distinct(t))) AS c FROM tk)
SELECT conv_id, turn, em::INT::DOUBLE AS exact_match, CASE WHEN np = 0 OR nt = 0 OR c = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * (c / np) * (c / nt) / ((c / np) + (c / nt)), 6) END AS f1 FROM s""")
def qa_exact_f1(spark, sf_dir):
    p, t = F.col("prediction"), F.col("truth")
    return _qa(spark, sf_dir).select("conv_id", "turn", M.exact_match(p, t).alias("exact_match"), F.round(M.f1(p, t), 6).alias("f1"))


def _bleu_sql() -> str:
    grams = lambda c, n: f"list_transform(generate_series(1, len({c}) - {n - 1}), lambda i: array_to_string({c}[i:i+{n - 1}], chr(1)))"
    cols = ", ".join(f"CASE WHEN len(p) >= {n} THEN (SELECT count(*) FROM unnest({grams('p', n)}) u(g) WHERE list_contains(CASE WHEN len(t) >= {n} THEN {grams('t', n)} ELSE [] END, g)) END AS h{n}, len(p) - {n - 1} AS n{n}" for n in range(1, 5))
    logs = " + ".join(f"CASE WHEN h{n} IS NULL THEN 0 ELSE ln(greatest(h{n}, 1)::DOUBLE / n{n}) END" for n in range(1, 5))
    none = " OR ".join(f"coalesce(h{n} = 0, false)" for n in range(1, 5))
    return f"WITH {_QA}, g AS (SELECT conv_id, turn, len(p) AS np, len(t) AS nt, {cols} FROM tk) SELECT conv_id, turn, CASE WHEN np = 0 OR nt = 0 OR {none} THEN 0.0::DOUBLE ELSE round(CASE WHEN np >= nt THEN 1.0::DOUBLE ELSE exp(1 - nt::DOUBLE / np) END * exp(({logs}) / least(np, 4)), 6) END AS bleu FROM g"


@_query(_bleu_sql())
def bleu_simplified(spark, sf_dir):
    return _qa(spark, sf_dir).select("conv_id", "turn", F.round(M.bleu(F.col("prediction"), F.col("truth")), 6).alias("bleu"))


_WER = r"""WITH RECURSIVE qa AS (SELECT conv_id, turn, coalesce(text, '') AS p, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS t, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations),
w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(t), '\s+'), lambda x: x <> '') AS r, list_filter(regexp_split_to_array(lower(p), '\s+'), lambda x: x <> '') AS h FROM qa WHERE nx IS NOT NULL),
dp AS (SELECT conv_id, turn, r, h, 0 AS i, range(0, len(h) + 1) AS row FROM w
  UNION ALL SELECT conv_id, turn, r, h, i + 1, list_transform(range(0, len(h) + 1), lambda j: j + list_min(list_transform(best[1:j + 1], lambda b, k: b - (k - 1))))
  FROM (SELECT *, list_transform(range(0, len(h) + 1), lambda j: CASE WHEN j = 0 THEN (i + 1)::BIGINT ELSE least(row[j + 1] + 1, row[j] + (h[j] <> r[i + 1])::INT) END) AS best FROM dp WHERE i < len(r)))
SELECT conv_id, turn, round(row[len(row)]::DOUBLE / greatest(len(r), 1), 6) AS wer FROM dp WHERE i = len(r)"""


@_query(_WER)
def wer_words(spark, sf_dir):
    return _qa(spark, sf_dir).select("conv_id", "turn", F.round(M.wer(F.col("truth"), F.col("prediction")), 6).alias("wer"))


@_query(r"""WITH c AS (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 450)) AS start FROM documents WHERE length(text) > 0), x AS (SELECT doc_id, start, substr(text, start + 1, 500) AS chunk FROM c)
SELECT doc_id, (start // 450)::BIGINT AS chunk_index, start::BIGINT AS start, chunk, doc_id || '_chunk_' || lpad((start // 450)::VARCHAR, greatest(4, 4), '0') AS chunk_id, length(chunk) AS char_count,
 len(list_filter(regexp_split_to_array(chunk, '\s+'), lambda w: w <> '')) AS word_count FROM x WHERE regexp_replace(chunk, '^\s+|\s+$', '', 'g') <> ''""")
def chunk_fixed_offset(spark, sf_dir):
    return chunking.fixed_offset(_table(spark, sf_dir, "documents")).withColumns({"chunk_index": F.col("chunk_index").cast("long"), "start": F.col("start").cast("long")})


_SENT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@_query(f"WITH s AS (SELECT doc_id, {_SENT} AS a FROM documents) SELECT doc_id, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS position FROM s")
def chunk_sentences(spark, sf_dir):
    return chunking.sentence_rows(_table(spark, sf_dir, "documents")).withColumn("position", F.col("position").cast("long"))


_PACKED = r"""WITH RECURSIVE l AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS a FROM documents WHERE text <> ''),
s AS (SELECT doc_id, len(a) AS n, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM l),
p AS (SELECT doc_id, n, 1 AS i, s AS now, NULL::VARCHAR AS done FROM s WHERE i = 1
  UNION ALL SELECT p.doc_id, p.n, p.i + 1, CASE WHEN now <> '' AND length(now) + length(s.s) > 500 THEN right(now, 50) || ' ' || s.s WHEN now <> '' THEN now || ' ' || s.s ELSE s.s END, CASE WHEN now <> '' AND length(now) + length(s.s) > 500 THEN now END
  FROM p JOIN s ON s.doc_id = p.doc_id AND s.i = p.i + 1),
c AS (SELECT doc_id, i, regexp_replace(done, '^\s+|\s+$', '', 'g') AS chunk FROM p WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, regexp_replace(now, '^\s+|\s+$', '', 'g') FROM p WHERE i = n),
k AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM c WHERE chunk <> '')
SELECT doc_id, pos::INTEGER AS chunk_index, chunk, doc_id || '_chunk_' || lpad(pos::VARCHAR, 4, '0') AS chunk_id, length(chunk) AS char_count, len(list_filter(regexp_split_to_array(chunk, '\s+'), lambda x: x <> '')) AS word_count FROM k"""


@_query(_PACKED)
def chunk_sentence_packed(spark, sf_dir):
    return chunking.chunk(_table(spark, sf_dir, "documents", spread=True), "sentence")


@_query()
def chunk_recursive(spark, sf_dir):
    return chunking.chunk(_table(spark, sf_dir, "documents", spread=True), "recursive")


@_query()
def chunk_semantic(spark, sf_dir):
    return chunking.chunk(_table(spark, sf_dir, "documents", spread=True), "semantic")


@_query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS part FROM documents),
o AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l)
SELECT doc_id, part, (pos + length(raw) - length(regexp_replace(raw, '^\s+', '')))::BIGINT AS start, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS chunk FROM o WHERE length(regexp_replace(raw, '^\s+|\s+$', '', 'g')) >= 100""")
def paragraph_chunks(spark, sf_dir):
    return chunking.paragraphs(_table(spark, sf_dir, "documents"), by=r"\n")


@_query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT label, vec_id, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM e),
t AS (SELECT label, vec_id, round(list_dot_product(v, u) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(u, u))), 6) AS similarity FROM s), q AS (SELECT label, quantile_cont(similarity, 0.05) AS low FROM t GROUP BY 1),
b AS (SELECT label, vec_id, similarity, coalesce(similarity < low, false) AS is_break FROM t JOIN q USING (label))
SELECT label, vec_id, similarity, is_break, sum(is_break::BIGINT) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT AS block FROM b""")
def semantic_breaks(spark, sf_dir):
    """The row before and the number of breaks so far over ranges of (label, id): a label may hold any share of the rows."""
    from corvane.functions.vectors import cosine

    e = ordered.dealt_in_order(_table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id")
    steps = ordered.with_previous(e, "label", "vec_id", ["embedding"])
    steps = steps.select("label", "vec_id", ordered.PART, F.when(~F.col("is_first"), F.round(cosine(F.col("embedding"), F.col("previous_embedding")), 6)).alias("similarity"))
    low = steps.groupBy(F.col("label").alias("its")).agg(F.percentile("similarity", F.lit(0.05)).alias("low"))
    flagged = steps.join(low, F.col("label").eqNullSafe(F.col("its"))).withColumn("is_break", F.coalesce(F.col("similarity") < F.col("low"), F.lit(False))).withColumn("one", F.col("is_break").cast("long"))
    return ordered.with_running_sum(flagged, "label", "vec_id", "one", "block").select("label", "vec_id", "similarity", "is_break", "block")


_TOP = f"top AS (SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm WHERE score > 0) WHERE rank <= 5)"
_BARE = r"list_filter(list_transform(regexp_split_to_array(d.text, '[.!?]\s+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 10)"
_EXTRACT = rf"""{_TOP},
ss AS (SELECT query_id, id, rank, length(d.text) AS original_length, unnest({_BARE}) AS s, generate_subscripts({_BARE}, 1) AS i, list_distinct(regexp_extract_all(lower(b.text), '{_TOK}')) AS q FROM top JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = query_id),
sc AS (SELECT *, len(list_intersect(q, list_distinct(regexp_extract_all(lower(s), '{_TOK}')))) AS o FROM ss),
so AS (SELECT *, round(o::DOUBLE / len(q) * CASE WHEN o > 2 THEN 1.5 ELSE 1.0 END, 6) AS score FROM sc WHERE o > 0),
bs AS (SELECT * FROM so QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, i) <= 5),
ex AS (SELECT query_id, id, any_value(rank) AS rank, string_agg(s, ' ' ORDER BY score DESC, i) AS compressed, any_value(original_length) AS original_length FROM bs GROUP BY ALL)"""


def _top_pairs(spark, sf_dir):
    top = lexical.top_k(_bm25(spark, sf_dir), 5).select("query_id", "id", "rank")
    docs, q = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return top.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").join(q.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")


@_query(f"WITH {_BM25}, {_EXTRACT} SELECT query_id, id, compressed, original_length, length(compressed) AS compressed_length FROM ex")
def extractive_compress(spark, sf_dir):
    return answers.extractive_compress(_top_pairs(spark, sf_dir))


@_query(f"""WITH {_BM25}, {_EXTRACT}, nn AS (SELECT query_id, row_number() OVER w AS n, compressed AS t, length(compressed) // 4 AS est, coalesce(sum(length(compressed) // 4) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ex WINDOW w AS (PARTITION BY query_id ORDER BY rank))
SELECT query_id, string_agg(n || '. ' || CASE WHEN before + est > 300 THEN substr(t, 1, ((300 - before) * 4)::BIGINT) || '...' ELSE t END, chr(10) || chr(10) ORDER BY n) AS context FROM nn WHERE before < 300 GROUP BY query_id""")
def context_budget(spark, sf_dir):
    ex = answers.extractive_compress(_top_pairs(spark, sf_dir), keys=("query_id", "id", "rank"))
    return answers.context_budget(ex, 300, text_col="compressed")


_DOMAIN = "|".join(T.CONTENT_WORDS)
_TERMS = rf"""list_distinct(regexp_extract_all(c, '\d+(?:\.\d+)?%?') || regexp_extract_all(c, '"([^"]+)"', 1) || list_filter(regexp_split_to_array(c, '\s+'), lambda w: length(w) > 3 AND regexp_matches(w, '^\p{{Lu}}')) || list_transform(regexp_extract_all(' ' || lower(c) || ' ', '[^\p{{L}}\p{{N}}_]({_DOMAIN})[^\p{{L}}\p{{N}}_]'), lambda w: substr(w, 2, length(w) - 2)))"""
_TRANS = " OR ".join(f"contains(lower(x), '{p}')" for p in T.TRANSITIONAL_PHRASES)
_CLAIMS = rf"""an AS (SELECT conv_id, turn, text AS answer, lower(coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS ctx, role FROM conversations),
aa AS (SELECT *, list_filter(list_transform(regexp_split_to_array(coalesce(answer, ''), '[.!?]\s+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 15 AND NOT ({_TRANS})) AS cl FROM an WHERE role = 'assistant'),
cr AS (SELECT conv_id, turn, ctx, unnest(cl) AS c, generate_subscripts(cl, 1) - 1 AS claim_no FROM aa),
ct AS (SELECT *, {_TERMS} AS terms FROM cr),
cc AS (SELECT conv_id, turn, claim_no, c AS claim, len(terms) AS n_terms, len(list_filter(terms, lambda t: contains(ctx, lower(t)))) AS n_found FROM ct)"""


def _answers(spark, sf_dir):
    """Each answer with all that was said before it. A conversation is gathered once; a turn's context is a slice of it."""
    turn = F.struct("turn", "role", "text")
    whole = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    rows = whole.select("conv_id", "turns", F.posexplode("turns").alias("at", "t")).filter("t.role = 'assistant'")
    return rows.select("conv_id", "t.turn", F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("at")), lambda x: x["text"]), " ").alias("context"), F.col("t.text").alias("answer"))


@_query(f"WITH {_CLAIMS} SELECT conv_id, turn, claim_no, claim, n_terms, n_found, CASE WHEN n_terms = 0 THEN 0.0::DOUBLE ELSE round(n_found::DOUBLE / n_terms, 6) END AS coverage, n_terms > 0 AND n_found * 2 >= n_terms AS grounded FROM cc")
def grounding_claims(spark, sf_dir):
    return answers.claim_rows(_answers(spark, sf_dir), keys=("conv_id", "turn")).withColumn("claim_no", F.col("claim_no").cast("long"))


def _verify_sql() -> str:
    ind = " + ".join(f"contains(lower(answer), '{p}')::INT" for p in T.INFERENCE_INDICATORS)
    none = " OR ".join(f"contains(lower(answer), '{p}')" for p in T.NO_INFO_PHRASES)
    return f"""WITH {_CLAIMS}, g AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (n_terms > 0 AND n_found * 2 >= n_terms) AS g FROM cc GROUP BY ALL),
v AS (SELECT aa.conv_id, aa.turn, ({none}) AS no_info, coalesce(n, 0) AS n_claims, coalesce(g, 0) AS n_grounded, ({ind})::BIGINT AS n_indicators FROM aa LEFT JOIN g USING (conv_id, turn)),
c AS (SELECT *, CASE WHEN n_claims = 0 THEN 0.0::DOUBLE ELSE n_grounded::DOUBLE / n_claims END AS cov FROM v),
k AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, cov * 0.6::DOUBLE + 0.5::DOUBLE * 0.4::DOUBLE - (least(0.3::DOUBLE, n_indicators * 0.1::DOUBLE) + CASE WHEN n_claims = 0 THEN 0.3::DOUBLE WHEN n_claims > 10 THEN 0.1::DOUBLE ELSE 0::DOUBLE END))) AS conf FROM c),
r AS (SELECT conv_id, turn, no_info, n_claims, n_grounded, n_indicators, CASE WHEN no_info THEN 1.0::DOUBLE ELSE round(cov, 6) END AS coverage, CASE WHEN no_info THEN 1.0::DOUBLE ELSE round(conf, 6) END AS confidence FROM k),
l AS (SELECT *, CASE WHEN no_info THEN 'fully_grounded' WHEN coverage >= 0.8 AND confidence >= 0.7 THEN 'fully_grounded' WHEN coverage >= 0.5 OR confidence >= 0.5 THEN 'partially_grounded' WHEN n_claims - n_grounded > 3 OR confidence < 0.3 THEN 'likely_hallucinated' ELSE 'unverifiable' END AS level, NOT no_info AND confidence < 0.4 AS should_abstain FROM r)
SELECT *, CASE WHEN should_abstain THEN 'abstain' WHEN level = 'fully_grounded' THEN 'accept' WHEN level = 'partially_grounded' AND (n_grounded < n_claims OR n_indicators > 2) THEN 'accept_with_warning' WHEN level = 'partially_grounded' THEN 'accept' WHEN level = 'likely_hallucinated' THEN 'reject' ELSE 'manual_review' END AS action FROM l"""


@_query(_verify_sql())
def verify_answers(spark, sf_dir):
    return answers.verify(_answers(spark, sf_dir), keys=("conv_id", "turn"))
