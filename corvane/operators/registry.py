"""The registry of documents: filters, search, statistics, changes, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def registry_filter(df: DataFrame, file_type: str | None = None, status: str | None = None, category: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Equality on each given field; tags must all be there."""
    for name, want in (("file_type", file_type), ("status", status), ("category", category)):
        if want is not None:
            df = df.filter(F.col(name) == want)
    return df.filter(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), "tags")) == 0) if tags else df


def text_search(df: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Case-insensitive substring in the file name, a tag, the category or a metadata value."""
    q = query.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    out = df.filter(has(F.col("filename")) | F.coalesce(F.exists("tags", has), F.lit(False)) | has(F.col("category")) | F.coalesce(F.exists(F.map_values("metadata"), has), F.lit(False)))
    return out.limit(limit) if limit else out


def listing(df: DataFrame, sort_by: str = "uploaded_at", descending: bool = True, limit: int | None = None, tie: str = "id") -> DataFrame:
    """Sorted by any field, nulls as empty text; a limit becomes a top-k."""
    key = F.coalesce(F.col(sort_by).cast("string"), F.lit("")) if dict(df.dtypes)[sort_by] == "string" else F.col(sort_by)
    out = df.orderBy(key.desc() if descending else key.asc(), tie)
    return out.limit(limit) if limit else out


def stats(df: DataFrame) -> DataFrame:
    """(kind, value, n, total_size, total_chunks, latest): totals, by type and by status, in one pass of grouping sets."""
    sets = df.groupingSets([[], [F.col("file_type")], [F.col("status")]], "file_type", "status")
    out = sets.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"), F.max("uploaded_at").alias("latest"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "type").otherwise("status")
    return out.select(kind.alias("kind"), F.coalesce("file_type", "status", F.lit("")).alias("value"), "n", "total_size", "total_chunks", "latest")


def media_counts(df: DataFrame, category: Column) -> DataFrame:
    return df.agg(F.count_if(category == "audio").alias("audio"), F.count_if(category == "video").alias("video"), F.count_if(category == "document").alias("document"), F.count(F.lit(1)).alias("total"))


def fresh_documents(batch: DataFrame, known: DataFrame | None = None, content: str = "content", order: str = "path", fail: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new, duplicates) by md5 of the content: against the registry (file_hash, id) and inside the batch, where the first by ``order`` stays.

    Duplicates carry existing_id. With ``fail`` a duplicate raises when it is read. The first of each content is found by an aggregation, map-side first, and met
    by a join, so a content that a third of all rows hold is in no task as a whole. Rows that agree in content and ``order`` are told apart by their other columns; rows that agree in all are all first.
    """
    h = batch.withColumn("file_hash", F.md5(F.col(content)))
    row = F.struct(order, F.xxhash64(*[c for c in batch.columns if c != content and not dict(batch.dtypes)[c].startswith("map")]))
    firsts = h.groupBy("file_hash").agg(F.min(row).alias("__first"))
    ranked = h.join(firsts, "file_hash").withColumn("__n", F.when(row == F.col("__first"), 1).otherwise(2)).drop("__first").select(*h.columns, "__n")
    if known is None:
        known = batch.sparkSession.createDataFrame([], "file_hash string, id string")
    have = known.groupBy("file_hash").agg(F.min("id").alias("existing_id"))
    j = ranked.join(have, "file_hash", "left")
    old = (F.col("__n") > 1) | F.col("existing_id").isNotNull()
    if fail:
        j = j.withColumn("existing_id", F.when(old, F.raise_error(F.concat(F.lit("duplicate of "), F.coalesce("existing_id", "file_hash"))).cast("string")))
    return j.filter(~old).drop("__n", "existing_id"), j.filter(old).drop("__n")


def document_id(key: Column) -> Column:
    """doc_ and the md5 of the key, whole: ids must not collide among many documents."""
    return F.concat(F.lit("doc_"), F.md5(key))


def point_id(doc: Column, index: Column) -> Column:
    return F.md5(F.concat_ws(":", doc.cast("string"), index.cast("string")))


def remove(df: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def upsert(df: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``updates`` replace those of the same key."""
    return remove(df, updates, key).unionByName(updates, allowMissingColumns=True)


def merge_metadata(df: DataFrame, changes: Column, column: str = "metadata") -> DataFrame:
    """Right wins."""
    old = F.map_filter(column, lambda k, v: ~F.array_contains(F.map_keys(changes), k))
    return df.withColumn(column, F.map_concat(old, changes))


def delete_by_filter(df: DataFrame, conditions: dict) -> DataFrame:
    """Rows that don't meet all equalities; rows with a null there stay."""
    keep = F.lit(False)
    for name, want in conditions.items():
        keep = keep | ~F.coalesce(F.col(name) == want, F.lit(False))
    return df.filter(keep)


#: Cells by which an eviction sums a cache: the driver gets one sum each.
EVICT_CELLS = 10_000


# Caches are tables (key, value, created_at, used_at, bytes).


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return wanted.join(cache.select(key).distinct(), key, "left_anti")


def cache_live(cache: DataFrame, as_of: str, ttl_hours: int = 24) -> DataFrame:
    return cache.filter(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(ttl_hours)} HOURS"))


def cache_evict(cache: DataFrame, limit: int, order: str = "used_at", size: str = "bytes", tie: str = "key", part: str | None = None, target: float = 0.8) -> DataFrame:
    """The newest entries that fit ``target`` of the limit, if the whole exceeds the limit; else all. ``part`` keeps caches apart.

    Without ``part``, entries are summed by cells of equal width of ``order`` (a time or a number); only the cell in which the sum passes the target is ranked in one task.
    """
    if not part:
        at = F.col(order).cast("double")
        low, high, total = cache.agg(F.min(at), F.max(at), F.sum(size)).first()
        if total is None or total <= limit:
            return cache
        cell = F.least(F.floor((at - F.lit(low)) / F.lit(max(high - low, 1e-9) / EVICT_CELLS)), F.lit(EVICT_CELLS - 1)).cast("long")
        room, edge = limit * target, None
        for c, n in cache.groupBy(cell.alias("c")).agg(F.sum(size).alias("n")).orderBy(F.col("c").desc_nulls_last()).collect():
            if n > room:
                edge = c
                break
            room -= n
        if edge is None:
            return cache.limit(0) if room == limit * target else cache
        run = Window.partitionBy(F.lit(1)).orderBy(F.col(order).desc(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, 0)
        within = cache.filter(cell == edge).withColumn("__run", F.sum(size).over(run)).filter(F.col("__run") <= room).drop("__run")
        return cache.filter(cell > edge).unionByName(within)
    w = Window.partitionBy(F.col(part))
    run = w.orderBy(F.col(order).desc(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return cache.withColumn("__all", F.sum(size).over(w)).withColumn("__run", F.sum(size).over(run)).filter((F.col("__all") <= limit) | (F.col("__run") <= limit * target)).drop("__all", "__run")


def bbox_overlap(a: Column, b: Column) -> Column:
    """Intersection over the first box's area (at least 1): not symmetric. Boxes are structs x0, y0, x1, y1."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h / F.greatest((a["x1"] - a["x0"]) * (a["y1"] - a["y0"]), F.lit(1.0))
