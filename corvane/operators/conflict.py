"""Conflicts between sources and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import OLD_KEYWORDS, UPDATE_KEYWORDS, contains_any, entities, key_values, parse_date, text_date

STRATEGIES = ("prefer_newer", "prefer_higher_score", "merge_all", "show_all_versions", "manual_review")


def dated(chunks: DataFrame, text_col: str = "text", date_col: str | None = "date") -> DataFrame:
    """Adds doc_date (the metadata date, else the first in the text), is_newer and is_older."""
    meta = parse_date(F.col(date_col)) if date_col else F.lit(None).cast("date")
    return chunks.withColumns({"doc_date": F.coalesce(meta, text_date(F.col(text_col))), "is_newer": contains_any(F.col(text_col), UPDATE_KEYWORDS), "is_older": contains_any(F.col(text_col), OLD_KEYWORDS)})


def topic(text: Column, query: Column) -> Column:
    """The first three, sorted, of the entities that a chunk shares with the query, or general."""
    common = F.array_sort(F.array_intersect(entities(text), entities(query)))
    return F.transform(F.array(common), lambda c: F.when(F.size(c) == 0, "general").otherwise(F.array_join(F.slice(c, 1, 3), "_")))[0]


def _stated(rows: DataFrame, query_col: str, id_col: str, text_col: str, group: str, *more: str) -> DataFrame:
    """(group, topic, id, more columns, key, value, plain): a row for each key that a chunk gives a value."""
    about = rows.select(group, topic(F.col(text_col), F.col(query_col)).alias("topic"), F.col(id_col).alias("id"), *more, F.explode(key_values(F.col(text_col))).alias("key", "value"))
    return about.withColumn("plain", F.regexp_replace("value", r"[,.\s]", ""))


def conflict_pairs(chunks: DataFrame, query_col: str = "query", id_col: str = "id", text_col: str = "text", date_col: str | None = "date", group: str = "query_id") -> DataFrame:
    """(group, topic, key, id_a, id_b, value_a, value_b, kind): values of one key that differ between two chunks of a topic.

    Values are compared without commas, dots and spaces. date if both chunks are dated, else version if only one speaks of an update, else value. An equi-join on (group, topic, key); a < b.
    """
    kv = _stated(dated(chunks, text_col, date_col), query_col, id_col, text_col, group, "doc_date", "is_newer")
    a, b = (kv.select(F.col(group).alias(group), "topic", "key", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "value", "plain", "doc_date", "is_newer")]) for s in "ab")
    j = a.join(b, [group, "topic", "key"]).filter((F.col("id_a") < F.col("id_b")) & (F.col("plain_a") != F.col("plain_b")))
    kind = F.when(F.col("doc_date_a").isNotNull() & F.col("doc_date_b").isNotNull(), "date").when(F.col("is_newer_a") != F.col("is_newer_b"), "version").otherwise("value")
    return j.select(group, "topic", "key", "id_a", "id_b", "value_a", "value_b", kind.alias("kind"))


def in_conflict(chunks: DataFrame, query_col: str = "query", id_col: str = "id", text_col: str = "text", group: str = "query_id") -> DataFrame:
    """(group, id): the chunks of :func:`conflict_pairs`, without making pairs. A chunk is one if some chunk of another id and the same topic gives the key another value.

    Counts tell: of all values under a key, those with its id or its value are taken off. Null groups and ids conflict with nothing.
    """
    kv = _stated(chunks, query_col, id_col, text_col, group).filter(F.col(group).isNotNull() & F.col("id").isNotNull())
    facts = kv.groupBy(group, "topic", "key", "id", "plain").agg(F.lit(1).alias("one"))
    n = lambda *by: F.count(F.lit(1)).over(Window.partitionBy(group, "topic", "key", *by))
    return facts.withColumn("others", n() - n("id") - n("plain") + 1).filter("others > 0").select(group, F.col("id").alias(id_col)).distinct()


def resolve(chunks: DataFrame, as_of: str, strategy: str = "prefer_newer", id_col: str = "id", text_col: str = "text", date_col: str | None = "date", score_col: str = "similarity", group: str = "query_id", conflicts: DataFrame | None = None, days: int = 3650, prefix: int = 200, digits: int = 6) -> DataFrame:
    """Chunks in order (rank) after resolution.

    prefer_newer: 0.4 * recency + 0.3 if it speaks of an update - 0.2 if of the past + 0.3 * score; of chunks
    with the same first ``prefix`` characters the best stays. prefer_higher_score: by score. merge_all and show_all_versions
    keep all and add a note to chunks in conflict; manual_review keeps all as they are.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    rows = dated(chunks, text_col, date_col)
    recency = F.coalesce(F.greatest(F.lit(0.0), 1 - F.datediff(F.lit(as_of).cast("date"), "doc_date") / float(days)), F.lit(0.0))
    score = F.coalesce(F.col(score_col), F.lit(0.5))
    if strategy == "prefer_newer":
        score = 0.4 * recency + F.when(F.col("is_newer"), 0.3).otherwise(0.0) - F.when(F.col("is_older"), 0.2).otherwise(0.0) + 0.3 * score
    rows = rows.withColumn("resolved_score", F.round(score, digits))
    best = Window.partitionBy(group, F.substring(text_col, 1, prefix)).orderBy(F.col("resolved_score").desc(), id_col)
    if strategy == "prefer_newer":
        rows = rows.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")
    if strategy in ("merge_all", "show_all_versions") and conflicts is not None:
        marked = conflicts.select(group, F.col("id_a").alias(id_col)).union(conflicts.select(group, "id_b")).distinct().withColumn("in_conflict", F.lit(True))
        stamp = F.concat(F.lit(" [version of "), F.coalesce(F.date_format("doc_date", "yyyy-MM-dd"), F.lit("unknown date")), F.lit("]"))
        rows = rows.join(marked, [group, id_col], "left").withColumn("note", F.when(F.col("in_conflict"), stamp if strategy == "show_all_versions" else F.lit(" [sources disagree]")).otherwise("")).drop("in_conflict")
    order = F.col(id_col) if strategy == "manual_review" else F.col("resolved_score").desc()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order, id_col)))


def resolve_by_all(chunks: DataFrame, strategies: tuple = STRATEGIES[1:], query_col: str = "query", id_col: str = "id", text_col: str = "text", date_col: str | None = "date", score_col: str = "similarity", group: str = "query_id", digits: int = 6) -> DataFrame:
    """(strategy, group, id, rank, note): what :func:`resolve` gives by each of several strategies that keep all chunks. Texts are read for dates once and for keys once, whatever their number."""
    if not set(strategies) <= set(STRATEGIES[1:]):
        raise ValueError(f"unknown strategy, or one that drops chunks, in {strategies}")
    rows = dated(chunks, text_col, date_col).select(group, id_col, "doc_date", F.round(F.coalesce(F.col(score_col), F.lit(0.5)), digits).alias("resolved_score"))
    marked = in_conflict(chunks, query_col, id_col, text_col, group).withColumn("disputed", F.lit(True))
    rows = rows.join(marked, [group, id_col], "left")
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("resolved_score").desc(), id_col))
    rows = rows.withColumn("place", place).withColumn("given", F.row_number().over(Window.partitionBy(group).orderBy(id_col)))
    stamp = F.concat(F.lit(" [version of "), F.coalesce(F.date_format("doc_date", "yyyy-MM-dd"), F.lit("unknown date")), F.lit("]"))
    notes = {"merge_all": F.lit(" [sources disagree]"), "show_all_versions": stamp}
    one = lambda s: F.struct(F.lit(s).alias("strategy"), F.col("given" if s == "manual_review" else "place").alias("rank"), (F.when(F.col("disputed"), notes[s]).otherwise("") if s in notes else F.lit("")).alias("note"))
    return rows.select(group, id_col, F.explode(F.array(*[one(s) for s in strategies])).alias("s")).select("s.strategy", group, id_col, "s.rank", "s.note")


def latest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order: one aggregation, map-side first."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")
