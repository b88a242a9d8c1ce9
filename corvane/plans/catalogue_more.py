"""More registered queries: abstention, conflicts, the registry, caches, formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import answers, conflict, evaluation, registry, search, spatial
from corvane.plans.catalogue import _PACKED, _PAIRS, K, _knn, _knn_sql, _query, _table
from corvane.sources import files


@_query(f"""WITH {_PAIRS}, h AS (SELECT * FROM {_knn_sql('cosine', K, 'query_id <> id')}), a AS (SELECT query_id, count(*) AS n_hits, max(score) AS max_score, count(*) FILTER (score >= 0.3) AS n_relevant FROM h GROUP BY 1)
SELECT q.vec_id AS query_id, coalesce(n_hits, 0) AS n_hits, max_score, coalesce(n_relevant, 0) AS n_relevant,
 CASE WHEN n_hits IS NULL THEN 'no_hits' WHEN max_score < 0.3 THEN 'low_similarity' WHEN n_relevant < 3 THEN 'too_few_relevant' ELSE 'answer' END AS reason, reason <> 'answer' AS abstain
FROM (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0) q LEFT JOIN a ON a.query_id = q.vec_id""")
def abstention(spark, sf_dir):
    q = _table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    return answers.abstention(q, _knn(spark, sf_dir, exclude_self=True), enough=3)


@_query(f"WITH {_PAIRS} SELECT query_id, round(sum(score / rank) / sum(1.0::DOUBLE / rank), 6) AS quality FROM {_knn_sql('cosine', K)} GROUP BY query_id")
def retrieval_quality(spark, sf_dir):
    return answers.retrieval_quality(_knn(spark, sf_dir))


#: Chunks that disagree, one for each order: its text states a total, some that they are updated or old, some a date. The chunks of a customer are those of one question.
_CHUNK_SQL = """chunks AS (SELECT o_custkey AS query_id, o_orderkey AS id, round(o_totalprice / 700001, 5) AS similarity, 'Order total = ' || floor(o_totalprice)::BIGINT || CASE WHEN o_orderpriority LIKE '1%' THEN ' updated' WHEN o_orderpriority LIKE '5%' THEN ' old' ELSE '' END
  || CASE WHEN o_orderstatus = 'O' THEN ' on ' || strftime(o_orderdate::DATE, '%Y-%m-%d') ELSE '' END AS text FROM orders),
read AS (SELECT *, lower(trim(split_part(text, '=', 1))) AS key, regexp_extract(text, '= ([0-9]+)', 1) AS value, try_cast(nullif(regexp_extract(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '') AS DATE) AS doc_date, contains(text, 'updated') AS newer, contains(text, 'old') AS older FROM chunks)"""


def _chunks(spark, sf_dir):
    p, none = F.col("o_orderpriority"), F.lit("")
    word = F.when(p.startswith("1"), " updated").when(p.startswith("5"), " old").otherwise(none)
    day = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit(" on "), F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"))).otherwise(none)
    text = F.concat(F.lit("Order total = "), F.floor("o_totalprice").cast("long").cast("string"), word, day)
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 700001, 5).cast("double").alias("similarity"), text.alias("text"), F.lit("Order status").alias("query"))


@_query(f"""WITH {_CHUNK_SQL} SELECT a.query_id, 'order' AS topic, a.key, a.id AS id_a, b.id AS id_b, a.value AS value_a, b.value AS value_b, CASE WHEN a.doc_date IS NOT NULL AND b.doc_date IS NOT NULL THEN 'date' WHEN a.newer <> b.newer THEN 'version' ELSE 'value' END AS kind
FROM read a JOIN read b ON a.query_id = b.query_id AND a.key = b.key AND a.id < b.id AND a.value <> b.value""")
def conflict_pairs(spark, sf_dir):
    return conflict.conflict_pairs(_chunks(spark, sf_dir), date_col=None)


@_query(f"""WITH {_CHUNK_SQL}, s AS (SELECT *, round(coalesce(0.4::DOUBLE * greatest(0.0::DOUBLE, 1 - date_diff('day', doc_date, DATE '1999-01-01') / 3650.0::DOUBLE), 0) + CASE WHEN newer THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN older THEN 0.2::DOUBLE ELSE 0 END + 0.3::DOUBLE * similarity, 6) AS resolved_score FROM read),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, substr(text, 1, 200) ORDER BY resolved_score DESC, id) = 1)
SELECT query_id, id, strftime(doc_date, '%Y-%m-%d') AS doc_date, resolved_score, row_number() OVER (PARTITION BY query_id ORDER BY resolved_score DESC, id) AS rank FROM f""")
def conflict_resolve_newer(spark, sf_dir):
    return conflict.resolve(_chunks(spark, sf_dir), "1999-01-01", date_col=None).select("query_id", "id", F.date_format("doc_date", "yyyy-MM-dd").alias("doc_date"), "resolved_score", F.col("rank").cast("long").alias("rank"))


@_query(f"""WITH {_CHUNK_SQL}, c AS (SELECT *, max(value) OVER (PARTITION BY query_id) <> min(value) OVER (PARTITION BY query_id) AS disputed, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place, row_number() OVER (PARTITION BY query_id ORDER BY id) AS pos FROM read)
SELECT 'prefer_higher_score' AS strategy, query_id, id, place AS rank, '' AS note FROM c UNION ALL SELECT 'manual_review', query_id, id, pos, '' FROM c
UNION ALL SELECT 'merge_all', query_id, id, place, CASE WHEN disputed THEN ' [sources disagree]' ELSE '' END FROM c
UNION ALL SELECT 'show_all_versions', query_id, id, place, CASE WHEN disputed THEN ' [version of ' || coalesce(strftime(doc_date, '%Y-%m-%d'), 'unknown date') || ']' ELSE '' END FROM c""")
def conflict_strategies(spark, sf_dir):
    """The strategies but prefer_newer, which has a query of its own."""
    return conflict.resolve_by_all(_chunks(spark, sf_dir), date_col=None).withColumn("rank", F.col("rank").cast("long"))


@_query(f"""WITH {_PAIRS}, h AS (SELECT * FROM {_knn_sql('cosine', 2 * K)}), d AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - date_diff('day', (DATE '2019-01-01' + (id % 2000)::INT), DATE '2024-01-01') / 1825.0::DOUBLE)) AS ds FROM h),
b AS (SELECT query_id, id, score, round(ds, 6) AS date_score, round(score * (1 - 0.2::DOUBLE) + ds * 0.2::DOUBLE, 6) AS boosted FROM d)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, id) AS rank FROM b QUALIFY rank <= {K}""")
def date_aware_search(spark, sf_dir):
    p = _table(spark, sf_dir, "embeddings").withColumns({"day": F.date_add(F.lit("2019-01-01").cast("date"), F.pmod("vec_id", F.lit(2000)).cast("int")), "text": F.lit("")})
    return search.date_aware(p, p.filter("vec_id % 20 = 0"), "2024-01-01", K, date_col="day").withColumn("rank", F.col("rank").cast("long"))


class _Head:
    """A generator that answers with the first 80 characters of the passage it is given."""

    def answer(self, prompt: str) -> str:
        return prompt.split("Passage:\n", 1)[1][:80]


@_query(r"""SELECT doc_id AS id, length(text) AS original_length, length(c) AS compressed_length, c AS compressed FROM (SELECT doc_id, text, CASE WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) < 50 THEN text ELSE regexp_replace(substr(text, 1, 80), '^\s+|\s+$', '', 'g') END AS c FROM documents)""")
def generated_compress(spark, sf_dir):
    d = _table(spark, sf_dir, "documents", spread=True).select(F.col("doc_id").alias("id"), "text", F.lit("what is it about").alias("query"))
    return answers.compress(d, "llm", _Head(), keys=("id",))


@_query(f"""WITH {_PAIRS}, h AS (SELECT * FROM {_knn_sql('cosine', K, 'query_id <> id')}), a AS (SELECT query_id, count(*) AS n_hits, max(score) AS max_score, count(*) FILTER (score >= 0.3) AS n_relevant FROM h GROUP BY 1),
q AS (SELECT vec_id AS query_id, repeat('x', (vec_id % 140)::INT) AS context FROM embeddings WHERE vec_id % 20 = 0)
SELECT q.query_id, coalesce(n_hits, 0) AS n_hits, max_score, coalesce(n_relevant, 0) AS n_relevant,
 CASE WHEN n_hits IS NULL THEN 'no_hits' WHEN max_score < 0.3 THEN 'low_similarity' WHEN n_relevant < 1 THEN 'too_few_relevant' WHEN length(context) BETWEEN 1 AND 49 THEN 'short_context' ELSE 'answer' END AS reason, reason <> 'answer' AS abstain
FROM q LEFT JOIN a USING (query_id)""")
def abstention_short_context(spark, sf_dir):
    q = _table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.expr("repeat('x', cast(vec_id % 140 as int))").alias("context"))
    return answers.abstention(q, _knn(spark, sf_dir, exclude_self=True), contexts=q)


@_query("SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_wins(spark, sf_dir):
    return conflict.latest_wins(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@_query("""WITH e AS (SELECT o_orderkey, round(o_totalprice / 700001, 6) AS score, CASE WHEN o_orderpriority LIKE '1%' THEN 'updated ' || o_orderpriority WHEN o_orderpriority LIKE '5%' THEN 'old ' || o_orderpriority ELSE o_orderpriority END AS text, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate::DATE END AS date FROM orders),
k AS (SELECT *, CASE WHEN date IS NULL THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - date_diff('day', date, DATE '2000-01-01') / 1825.0::DOUBLE) END + CASE WHEN contains(text, 'updated') THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN contains(text, 'old') THEN 0.2::DOUBLE ELSE 0 END AS d FROM e),
c AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, d)) AS dd FROM k)
SELECT o_orderkey, score, round(dd, 6) AS date_score, round(score * (1 - 0.2::DOUBLE) + dd * 0.2::DOUBLE, 6) AS boosted FROM c""")
def date_boost(spark, sf_dir):
    p = F.col("o_orderpriority")
    hits = _table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 700001, 6).alias("score"), F.when(p.startswith("1"), F.concat(F.lit("updated "), p)).when(p.startswith("5"), F.concat(F.lit("old "), p)).otherwise(p).alias("text"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate").cast("date")).alias("date"))
    return search.date_boost(hits, "2000-01-01").select("o_orderkey", "score", "date_score", "boosted")


@_query("SELECT doc_id, md5(coalesce(text, '')) AS file_hash FROM documents QUALIFY row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) = 1")
def doc_dedup_md5(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    new, _ = registry.fresh_documents(d, order="doc_id")
    return new.select("doc_id", "file_hash")


_REG = """reg AS (SELECT 'doc_' || md5(d.doc_id::VARCHAR) AS id, d.doc_id || '.' || lang AS filename, lang AS file_type, CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'processed' ELSE 'failed' END AS status,
 source AS category, CASE WHEN toxic = 1 THEN ['toxic', lang] ELSE [lang] END AS tags, n_chars AS file_size, (n_chars // 450 + 1)::BIGINT AS chunk_count, DATE '2024-01-01' + (d.doc_id % 365)::INT AS uploaded_at FROM documents d LEFT JOIN labels USING (doc_id))"""


def _registry(spark, sf_dir):
    d, lab = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        registry.document_id(F.col("doc_id").cast("string")).alias("id"), F.concat_ws(".", F.col("doc_id").cast("string"), "lang").alias("filename"), F.col("lang").alias("file_type"),
        F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "processed").otherwise("failed").alias("status"), F.col("source").alias("category"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"), "lang")).otherwise(F.array("lang")).alias("tags"), F.create_map(F.lit("origin"), F.concat(F.lit("crawl of "), "source")).alias("metadata"),
        F.col("n_chars").alias("file_size"), (F.floor(F.col("n_chars") / 450) + 1).cast("long").alias("chunk_count"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int")).alias("uploaded_at"),
    )


@_query(f"""WITH {_REG} SELECT CASE WHEN grouping(file_type) = 0 THEN 'type' WHEN grouping(status) = 0 THEN 'status' ELSE 'total' END AS kind, coalesce(file_type, status, '') AS value, count(*) AS n, sum(file_size)::BIGINT AS total_size, sum(chunk_count)::BIGINT AS total_chunks, strftime(max(uploaded_at), '%Y-%m-%d') AS latest
FROM reg GROUP BY GROUPING SETS ((), (file_type), (status))""")
def kb_stats(spark, sf_dir):
    return registry.stats(_registry(spark, sf_dir)).withColumn("latest", F.date_format("latest", "yyyy-MM-dd"))


@_query(f"WITH {_REG} SELECT id, filename, category, file_size FROM reg WHERE file_type = 'en' AND status = 'processed' AND list_contains(tags, 'toxic') AND list_contains(tags, 'en')")
def kb_filter(spark, sf_dir):
    return registry.registry_filter(_registry(spark, sf_dir), "en", "processed", tags=["toxic", "en"]).select("id", "filename", "category", "file_size")


@_query(f"WITH {_REG} SELECT id, filename, category FROM reg WHERE contains(lower(filename), 'src1') OR len(list_filter(tags, lambda t: contains(lower(t), 'src1'))) > 0 OR contains(lower(category), 'src1') OR contains(lower('crawl of ' || category), 'src1')")
def kb_text_search(spark, sf_dir):
    return registry.text_search(_registry(spark, sf_dir), "SRC1").select("id", "filename", "category")


@_query(f"WITH {_REG} SELECT id, filename, file_size FROM reg ORDER BY file_size DESC, id LIMIT 25")
def kb_listing(spark, sf_dir):
    return registry.listing(_registry(spark, sf_dir), "file_size", True, 25).select("id", "filename", "file_size")


@_query("SELECT doc_id, md5('hash:64:' || coalesce(text, '')) AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_cache(spark, sf_dir):
    key = registry.cache_key(F.lit("hash"), F.lit("64"), F.coalesce("text", F.lit("")))
    d, lab = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return registry.cache_misses(d.select("doc_id", key.alias("key")), lab.select("doc_id"), "doc_id")


@_query("""WITH c AS (SELECT user_id, event_id, ts, (1 + length(props))::BIGINT AS bytes FROM events), r AS (SELECT *, sum(bytes) OVER (PARTITION BY user_id) AS total, sum(bytes) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, event_id, bytes FROM r WHERE total <= 300 OR run <= 300 * 0.8""")
def cache_eviction(spark, sf_dir):
    c = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (1 + F.length("props")).cast("long").alias("bytes"))
    return registry.cache_evict(c, 300, "ts", "bytes", "event_id", "user_id").select("user_id", "event_id", "bytes")


@_query("""WITH b AS (SELECT l_orderkey AS page, l_linenumber AS id, l_quantity::DOUBLE AS x0, l_linenumber * 5.0::DOUBLE AS y0, l_quantity::DOUBLE + 10 AS x1, l_linenumber * 5.0::DOUBLE + 2 + l_quantity::DOUBLE AS y1 FROM lineitem)
SELECT a.page, a.id AS id_a, c.id AS id_b, round((least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)) / greatest((a.x1 - a.x0) * (a.y1 - a.y0), 1), 6) AS overlap
FROM b a JOIN b c ON a.page = c.page AND a.id <> c.id AND least(a.x1, c.x1) > greatest(a.x0, c.x0) AND least(a.y1, c.y1) > greatest(a.y0, c.y0)""")
def bbox_overlap(spark, sf_dir):
    """A box for each line item, on a page for each order."""
    q, line = F.col("l_quantity").cast("double"), F.col("l_linenumber") * 5.0
    b = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), F.struct(q.alias("x0"), line.alias("y0"), (q + 10).alias("x1"), (line + 2 + q).alias("y1")).alias("box"))
    x, y = (b.select("page", F.col("id").alias(f"id_{s}"), F.col("box").alias(f"box_{s}")) for s in "ab")
    meet = (F.least("box_a.x1", "box_b.x1") > F.greatest("box_a.x0", "box_b.x0")) & (F.least("box_a.y1", "box_b.y1") > F.greatest("box_a.y0", "box_b.y0"))
    return x.join(y, "page").filter((F.col("id_a") != F.col("id_b")) & meet).select("page", "id_a", "id_b", F.round(registry.bbox_overlap(F.col("box_a"), F.col("box_b")), 6).alias("overlap"))


@_query("""WITH e AS (SELECT event_id, floor(abs(value) * 1000) / 4 AS s FROM events)
SELECT event_id, format('{:02d}:{:02d}', (floor(s)::BIGINT // 60), floor(s)::BIGINT % 60) AS mm_ss, format('{:02d}:{:02d}:{:05.2f}', floor(s / 3600)::BIGINT, floor(s % 3600 / 60)::BIGINT, s % 60) AS hh_mm_ss,
 format('{:02d}:{:02d}:{:02d},{:03d}', floor(s)::BIGINT // 3600, floor(s)::BIGINT % 3600 // 60, floor(s)::BIGINT % 60, floor(s % 1 * 1000)::BIGINT) AS srt, (length(event_id::VARCHAR) // 4)::BIGINT AS tokens FROM e""")
def format_timestamps(spark, sf_dir):
    s = F.floor(F.abs("value") * 1000) / 4
    return _table(spark, sf_dir, "events").select("event_id", T.mm_ss(s).alias("mm_ss"), T.hh_mm_ss(s).alias("hh_mm_ss"), T.srt_time(s).alias("srt"), T.estimate_tokens(F.col("event_id").cast("string")).alias("tokens"))


_GRID = {"chunk_size": [300, 500, 800], "overlap": [30, 50], "top_k": [3, 5], "alpha": [0.5, 0.7]}


@_query("""SELECT c.x AS chunk_size, o.x AS overlap, t.x AS top_k, a.x AS alpha, round(0.3::DOUBLE * (t.x / 5.0::DOUBLE) + 0.3::DOUBLE * a.x + 0.2::DOUBLE * (o.x / 100.0::DOUBLE) + 0.2::DOUBLE * (c.x / 1000.0::DOUBLE), 6) AS score
FROM (VALUES (300::BIGINT), (500), (800)) c(x), (VALUES (30::BIGINT), (50)) o(x), (VALUES (3::BIGINT), (5)) t(x), (VALUES (0.5::DOUBLE), (0.7::DOUBLE)) a(x)""")
def param_grid_score(spark, sf_dir):
    g = evaluation.parameter_grid(spark, _GRID)
    score = evaluation.tuning_score(F.col("top_k") / 5.0, F.col("alpha"), F.col("overlap") / 100.0, F.col("chunk_size") / 1000.0)
    return g.select("chunk_size", "overlap", "top_k", "alpha", F.round(score, 6).alias("score"))


@_query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS text FROM pages""")
def html_text_extract(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", files.strip_markup(F.col("html")).alias("text"))


@_query("""SELECT doc_id AS id, trim(substr(string_split(text, '.')[1], 1, 150)) AS query FROM documents WHERE length(text) >= 50 AND length(trim(substr(string_split(text, '.')[1], 1, 150))) > 20""")
def generated_queries(spark, sf_dir):
    return evaluation.generated_queries(_table(spark, sf_dir, "documents"), most=None)


@_query("""WITH f AS (SELECT event_id, event_type AS engine, abs(value) AS took, abs(value) * 4 + 1 AS audio FROM events) SELECT engine, round(avg(took / audio), 6) AS mean_rtf, round(sum(took) / sum(audio), 6) AS total_rtf, round(sum(audio) / sum(took), 6) AS speed_up FROM f GROUP BY engine""")
def speech_speed(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.abs("value").alias("took_seconds"), (F.abs("value") * 4 + 1).alias("audio_seconds"))
    return evaluation.speech_speed(e)


@_query("""WITH t AS (SELECT conv_id, turn, text, (turn * 2)::DOUBLE AS s, (turn * 2 + 1.5)::DOUBLE AS e FROM conversations)
SELECT conv_id, string_agg('[' || format('{:02d}:{:02d}', (s::BIGINT) // 60, (s::BIGINT) % 60) || ' - ' || format('{:02d}:{:02d}', floor(e)::BIGINT // 60, floor(e)::BIGINT % 60) || '] ' || text, chr(10) ORDER BY turn) AS transcript FROM t GROUP BY conv_id""")
def transcript_text(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("turn") * 2).cast("double").alias("start"), (F.col("turn") * 2 + 1.5).cast("double").alias("end"))
    from corvane.sources import transcripts

    return transcripts.timed_text(c, "conv_id", "turn")


@_query()
def transcript_chunks(spark, sf_dir):
    from corvane.operators import chunking

    c = _table(spark, sf_dir, "conversations")
    seg = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("int").alias("id"), (F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + 1.5).alias("end"), "text"))).alias("segments"))
    return chunking.chunk_transcripts(seg, id_col="conv_id")


@_query("SELECT lang, count(*) AS n, count(*) FILTER (n_chars >= 500) AS kept, round(coalesce(avg(n_chars / 40000.0::DOUBLE) FILTER (n_chars >= 500), 0), 6) AS mean_confidence FROM documents GROUP BY lang")
def ocr_confidence(spark, sf_dir):
    from corvane.sources import files

    boxes = _table(spark, sf_dir, "documents").select(F.col("lang").alias("page"), (F.col("n_chars") / 40000.0).alias("confidence"))
    return files.ocr_summary(boxes, 500 / 40000.0).withColumnRenamed("page", "lang")


@_query("SELECT lower(CASE WHEN toxic = 1 THEN 'GROUNDED' ELSE 'Ungrounded' END) AS expected, CASE WHEN quality = 1 THEN 'grounded' ELSE 'ungrounded' END AS actual, count(*) AS n, expected = actual AS correct FROM labels GROUP BY ALL")
def grounding_confusion(spark, sf_dir):
    lab = _table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "GROUNDED").otherwise("Ungrounded").alias("expected"), F.when(F.col("quality") == 1, "grounded").otherwise("ungrounded").alias("actual"))
    return evaluation.grounding_confusion(lab)


@_query()
def rag_answers(spark, sf_dir):
    """The whole question-answering plan over all benchmark passages as questions."""
    from corvane.plans import rag

    q = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return rag.answer(_table(spark, sf_dir, "documents"), q)


#: A box for each order: prices across, dates down; orders of the lowest priority lie together in one place.
_ORDER_BOXES = """SELECT o_orderkey AS id, x0, y0, x0 + 20 + o_custkey % 180 AS x1, y0 + 0.05::DOUBLE * (1 + o_orderkey % 37) AS y1 FROM (SELECT *, CASE WHEN o_orderpriority LIKE '5%' THEN o_totalprice / 50 ELSE o_totalprice END::DOUBLE AS x0, o_orderkey * 7919 % 100000 / 100.0::DOUBLE AS y0 FROM orders)"""


@_query(f"""WITH b AS ({_ORDER_BOXES}) SELECT p.id AS id_a, q.id AS id_b, round((least(p.x1, q.x1) - greatest(p.x0, q.x0)) * (least(p.y1, q.y1) - greatest(p.y0, q.y0)), 4) AS area
FROM b p JOIN b q ON p.id < q.id AND p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1""")
def bbox_join(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    x0 = F.when(F.col("o_orderpriority").startswith("5"), F.col("o_totalprice") / 50).otherwise(F.col("o_totalprice")).cast("double")
    y0 = ((F.col("o_orderkey").cast("long") * 7919) % 100000) / F.lit(100.0)
    b = o.select(F.col("o_orderkey").alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 20 + F.col("o_custkey") % 180).alias("x1"), (y0 + 0.05 * (1 + F.col("o_orderkey") % 37)).alias("y1"))
    return spatial.overlapping(b).select("id_a", "id_b", F.round("area", 4).alias("area"))


@_query(_PACKED)
def chunk_sentence_udtf(spark, sf_dir):
    """Sentence packing by the table function, as SQL calls it."""
    from corvane.functions import table_functions

    table_functions.register(spark)
    docs = _table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    rows = spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunk_text(d.text, 'sentence', 500, 50) AS c", docs=docs)
    return rows.select("doc_id", "chunk_index", "chunk", F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.lpad(F.col("chunk_index").cast("string"), 4, "0")).alias("chunk_id"), "char_count", "word_count")


_OVER = "now <> '' AND length(now) + length(s.t) > 500"


@_query(rf"""WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, coalesce(text, '') AS t, turn * 2.0::DOUBLE AS a, turn * 2.0::DOUBLE + 1.5::DOUBLE AS b FROM conversations),
p AS (SELECT conv_id, i, t AS now, a, b, 1::BIGINT AS n, NULL::VARCHAR AS done, a AS da, b AS db, 0::BIGINT AS dn FROM s WHERE i = 1
  UNION ALL SELECT p.conv_id, s.i, CASE WHEN {_OVER} THEN right(now, 50) || ' ' || s.t WHEN now <> '' THEN now || ' ' || s.t ELSE s.t END, CASE WHEN {_OVER} THEN s.a ELSE p.a END, s.b, CASE WHEN {_OVER} THEN 1 ELSE p.n + 1 END, CASE WHEN {_OVER} THEN now END, p.a, p.b, p.n
  FROM p JOIN s ON s.conv_id = p.conv_id AND s.i = p.i + 1),
c AS (SELECT conv_id, i, done AS t, da AS a, db AS b, dn AS n FROM p WHERE done IS NOT NULL UNION ALL SELECT conv_id, i + 1, now, a, b, n FROM p WHERE now <> '' AND (conv_id, i) IN (SELECT (conv_id, max(i)) FROM s GROUP BY conv_id))
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INTEGER AS chunk_index, regexp_replace(t, '^\s+|\s+$', '', 'g') AS text, a AS start_time, b AS end_time, n AS n_segments, length(t) AS char_count, b - a AS duration, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS word_count FROM c""")
def transcript_segments(spark, sf_dir):
    """Conversations as timed segments, packed in their order by the table function: one row at a time, no conversation is gathered."""
    from corvane.functions import table_functions

    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + 1.5).alias("end"))
    return table_functions.packed(c, ["conv_id"], ["turn"]).drop("turn")


#: Phrases of three words, at every fifth place of the benchmark's texts.
_TRIPLES = "w AS (SELECT list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS a FROM benchmark), i AS (SELECT a, unnest(generate_series(1, len(a) - 2, 5)) AS i FROM w), g AS (SELECT DISTINCT a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] AS phrase FROM i)"


@_query(f"WITH {_TRIPLES} SELECT phrase, count(*) AS n_docs, sum(strpos(lower(text), phrase) - 1)::BIGINT AS first_places FROM documents JOIN g ON contains(lower(text), phrase) GROUP BY phrase")
def phrase_matches(spark, sf_dir):
    """In how many documents each of many phrases stands, and the sum of its first places: one walk over the texts, whatever the number of phrases."""
    from corvane.functions import phrases

    a = F.filter(F.split(F.lower("text"), " "), lambda x: x != "")
    words = _table(spark, sf_dir, "benchmark").select(a.alias("a")).filter("size(a) >= 3").select("a", F.explode(F.sequence(F.lit(0), F.size("a") - 3, F.lit(5))).alias("i"))
    asked = words.select(F.concat_ws(" ", *[F.get("a", F.col("i") + k) for k in range(3)]).alias("phrase")).distinct()
    hits = phrases.phrase_places(_table(spark, sf_dir, "documents", spread=True), asked.withColumn("phrase_id", F.col("phrase")))
    first = hits.groupBy("doc_id", F.col("phrase_id").alias("phrase")).agg(F.min("start").alias("start"))
    return first.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("start").cast("long").alias("first_places"))
