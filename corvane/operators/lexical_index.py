"""A BM25 index that is kept as a table: postings in blocks of documents, with what bounds the scores of each block.

``build`` makes one pass over texts and appends: each task cuts its documents into blocks of BLOCK and turns each block into one row a
token (places in the block, frequencies, and for classes of frequencies the shortest document). Nothing of earlier blocks is read or written. The table
is partitioned by the token's hash, so few queries read few folders.

``search`` finds the best k of each query without a table of (query, document) pairs. The bounds of the blocks, which are a small part of the
index, are summed for each (query, block). The most promising blocks of each query are scored first; the k-th score is a floor, and
only blocks whose sum of bounds reaches the floor are read at all. Inside a block, rare words are scored first; once the words left cannot lift a new
document to the floor, common words are only looked up for the documents still in the race.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions.text import tokens
from corvane.operators.lexical import BROADCAST_TERMS, B, K1, query_terms
from corvane.sources.tables import cut, spread_rows

#: Documents in a block, folders of tokens, and the classes of frequencies: up to 1, 2, 4 and so on.
BLOCK, BUCKETS, CLASSES = 1024, 16, 8
#: Blocks of each query that are scored first, and how many times as many each later round takes.
SEEDS, GROWTH = 2, 8
#: The folder of the blocks' documents.
DOCUMENTS = -1
#: Columns of the index, with the type of ids left open.
ROWS = "token string, block string, n long, at array<int>, tf array<int>, top_tf array<int>, top_len array<int>, ids array<{}>, lens array<long>"
#: Scores are rounded to so many digits before ranking; floors leave room for that.
DIGITS, ROOM = 6, 2e-6


def _block_rows(ids: pa.Array, lists: pa.ListArray, name: str, id_type: pa.DataType) -> pa.RecordBatch:
    """A block as rows: one for its documents, one for each token."""
    flat, lens = lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = flat.dictionary
    keys, tf = np.unique(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * BLOCK + np.repeat(np.arange(len(lens)), lens), return_counts=True)
    code, at = keys // BLOCK, keys % BLOCK
    offsets = np.r_[0, np.cumsum(np.bincount(code, minlength=len(words)))]
    level = np.minimum(np.ceil(np.log2(tf)), CLASSES - 1).astype(np.int64)
    shortest, most = np.full(len(words) * CLASSES, np.iinfo(np.int64).max), np.zeros(len(words) * CLASSES, np.int64)
    np.minimum.at(shortest, code * CLASSES + level, lens[at])
    np.maximum.at(most, code * CLASSES + level, tf)
    seen = most > 0
    tops = np.r_[0, np.cumsum(seen.reshape(-1, CLASSES).sum(axis=1))]
    lists_of = lambda off, x: pa.ListArray.from_arrays(pa.array(np.r_[0, off], pa.int32()), pa.array(x, pa.int32()))
    columns = [
        pa.array([None, *words.to_pylist()], pa.string()), pa.array([name] * (len(words) + 1)), pa.array([len(lens), *np.diff(offsets)], pa.int64()),
        lists_of(offsets, at), lists_of(offsets, tf), lists_of(tops, most[seen]), lists_of(tops, shortest[seen]),
        pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * (len(words) + 1), pa.int32()), ids.cast(id_type)), pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * (len(words) + 1), pa.int32()), pa.array(lens, pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["token", "block", "n", "at", "tf", "top_tf", "top_len", "ids", "lens"])


def block_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, block, n, at, tf, top_tf, top_len, ids, lens): the rows of new blocks. Rows without a token hold a block's documents: ids and lengths."""
    run_name, kind = uuid.uuid4().hex, dict(docs.dtypes)[id_col]
    arrow = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            for low in range(0, b.num_rows, BLOCK):
                piece = b.slice(low, BLOCK)
                # names don't change when a lost task runs again
                yield _block_rows(piece.column(0), piece.column(1), f"{run_name}-{part}-{seq}", arrow)
                seq += 1

    plain = docs.select(F.col(id_col), tokens(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("toks"))
    return plain.mapInArrow(run, ROWS.format(kind))


def bucket(token: Column | str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Append the blocks of ``docs`` to the index at ``path`` (made if it isn't there).

    Null texts are empty; documents with no token count in the averages. Rows that repeat an id are documents of their own.
    """
    rows = block_rows(spread_rows(docs.select(id_col, text_col)), id_col, text_col)
    dealt = rows.withColumn("bucket", F.when(F.col("token").isNull(), F.lit(DOCUMENTS)).otherwise(bucket("token")))
    # a number of its own, so that small indexes are written by all cores, too
    dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def impact(tf, length, avgdl: float, k1: float = K1, b: float = B):
    """What a posting adds to a score for each unit of its word's weight; for numbers, arrays and columns."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


class Index:
    """An index that was built at ``path`` from documents with ids of ``id_type``."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long"):
        self.rows = spark.read.schema(f"{ROWS.format(id_type)}, bucket int").parquet(path)  # an empty index has no file that would tell
        self.documents = self.rows.filter(F.col("bucket") == DOCUMENTS)
        got = self.documents.agg(F.sum("n").alias("n"), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total")).first()
        self.n, self.avgdl = int(got.n or 0), float(got.total or 0) / max(1, got.n or 0) or 1.0

    def heads(self, wanted: DataFrame) -> DataFrame:
        """(token, block, n, bound): of the wanted tokens (token), whose buckets alone are read."""
        here = [r.b for r in wanted.select(bucket("token").alias("b")).distinct().collect()]  # at most BUCKETS numbers
        bound = F.array_max(F.zip_with("top_tf", "top_len", lambda t, n: impact(t, n, self.avgdl)))
        return self.rows.filter(F.col("bucket").isin(here)).join(wanted.select(F.col("token").alias("w")), F.col("token") == F.col("w"), "left_semi").select("token", "block", "n", bound.alias("bound"))


def _scores(postings: dict, n: int, terms: list, floor: float, k: int, scored: list) -> np.ndarray:
    """Scores of a block's documents, exact for all that reach the floor and may be among the first k; others may be too low."""
    own = [(w * most, w, at, f, common) for t, w, common in terms if t in postings for at, f, most in (postings[t],)]
    own.sort(key=lambda x: -x[0])
    rest = np.r_[np.cumsum([x[0] for x in own][::-1])[::-1], 0.0]
    total, i = np.zeros(n), 0
    while i < len(own) and rest[i] >= floor:
        _, w, at, f, common = own[i]
        total[at] += w * f
        scored[0] += len(at)
        scored[1] += len(at) * common
        i += 1
        if n > k and i % 4 == 0:  # what documents have so far is a floor, too
            floor = max(floor, np.partition(total, n - k)[n - k] - ROOM)
    left = np.flatnonzero(total + rest[i] >= floor)
    for j in range(i, len(own)):
        _, w, at, f, common = own[j]
        where = np.minimum(np.searchsorted(at, left), len(at) - 1)
        hit = at[where] == left
        total[left[hit]] += w * f[where[hit]]
        scored[0] += int(hit.sum())
        scored[1] += int(hit.sum()) * common
        left = left[total[left] + rest[j + 1] >= floor]
    return total


def _score_blocks(index: Index, wanted: DataFrame, work: DataFrame, weights, k: int) -> DataFrame:
    """(query_id, id, score, scored, scored_common): of each (query_id, block, floor) the first k documents, and a row without a score that tells how many postings were scored."""
    id_type, q_type = index.rows.schema["ids"].dataType.elementType, work.schema["query_id"].dataType
    avgdl, id_arrow, q_arrow = index.avgdl, to_arrow_type(id_type), to_arrow_type(q_type)
    here = [r.b for r in wanted.select(bucket("token").alias("b")).distinct().collect()]
    work = cut(work, small=True)
    blocks = work.groupBy("block").agg(F.collect_list(F.struct("query_id", "floor")).alias("queries"))
    small = work.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    named = F.broadcast(blocks.select(F.col("block").alias("its"))) if small else blocks.select(F.col("block").alias("its"))
    asked = index.rows.filter(F.col("bucket").isin(here)).join(wanted.select(F.col("token").alias("w")), F.col("token") == F.col("w"), "left_semi").select("block", "token", "at", "tf").join(named, F.col("block") == F.col("its"), "left_semi")
    docs = index.documents.select("block", "ids", "lens").join(named, F.col("block") == F.col("its"), "left_semi").withColumn("kind", F.lit(0))
    stream = docs.unionByName(asked.withColumn("kind", F.lit(1)), True).unionByName(blocks.withColumn("kind", F.lit(2)), True).select("block", "kind", "ids", "lens", "token", "at", "tf", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of, ids, lens, postings, found_here = weights.value, [], np.empty(0), {}, {}
        for b in batches:
            out: list[tuple] = []
            kinds, tokens_ = b.column(1).to_numpy(), b.column(4)
            for i in range(b.num_rows):
                if kinds[i] == 0:
                    ids, lens, postings = b.column(2)[i].as_py(), np.array(b.column(3)[i].values, np.float64), {}
                elif kinds[i] == 1:
                    at = b.column(5)[i].values.to_numpy()
                    f = impact(b.column(6)[i].values.to_numpy().astype(np.float64), lens[at], avgdl)
                    postings[tokens_[i].as_py()] = at, f, f.max()
                else:
                    for asked_for in b.column(7)[i].as_py():
                        query, scored = asked_for["query_id"], [0, 0]
                        seen = found_here.get(query, [])  # the best scores of the blocks that this task has done
                        floor = max(asked_for["floor"], seen[-1] if len(seen) == k else 0.0)
                        total = np.round(_scores(postings, len(ids), terms_of[query], floor - ROOM, k, scored), DIGITS)
                        found = np.flatnonzero(total >= max(floor - ROOM, 10.0**-DIGITS / 2))
                        if len(found) > k:
                            found = found[total[found] >= np.partition(total[found], len(found) - k)[len(found) - k]]
                        best = sorted(((-total[x], ids[x]) for x in found), key=lambda r: (r[0], r[1] is None, 0 if r[1] is None else r[1]))[:k]
                        found_here[query] = sorted([*seen, *(-s for s, _ in best)], reverse=True)[:k]
                        out += [(query, who, -s, 0, 0) for s, who in best] + [(query, None, None, *scored)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (q_arrow, id_arrow, pa.float64(), pa.int64(), pa.int64()))], ["query_id", "id", "score", "scored", "scored_common"])

    # by a hash of its own: dealt by the joins' key the exchange would be left out, and the three parts of the union be coalesced apart
    dealt = stream.repartition(int(index.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("block")).sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(run, f"query_id {q_type.simpleString()}, id {id_type.simpleString()}, score double, scored long, scored_common long")


def search(index: Index, queries: DataFrame, k: int = 5, query_id: str = "query_id", query_col: str = "query", common: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(hits, counters): the first k of each query (query_id, id, score, rank), scores over 0 only, ties to the smaller id, as a search over all documents gives
    them; and (query_id, postings, scored, common_postings, common_scored): how many postings the query's words have and how many were
    scored, also of words in more than ``common`` of the documents.

    Up to BROADCAST_TERMS words of queries are handled at a time, counted first, whatever the number of queries.
    """
    every = cut(query_terms(queries, query_id, query_col), small=True)
    slices = max(1, -(-every.count() // BROADCAST_TERMS))
    parts = [_search(index, every if slices == 1 else every.filter(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i), k, common) for i in range(slices)]
    hits, counters = parts[0]
    for h, c in parts[1:]:
        hits, counters = hits.unionByName(h), counters.unionByName(c)
    return hits, counters


def _search(index: Index, terms: DataFrame, k: int, common: float) -> tuple[DataFrame, DataFrame]:
    spark = terms.sparkSession
    wanted = F.broadcast(terms.select("token").distinct())
    heads = cut(index.heads(wanted), small=True)
    frequency = heads.groupBy("token").agg(F.sum("n").alias("df"))
    idf = F.ln((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighted = cut(terms.join(frequency, "token").select("query_id", "token", (F.col("qf") * idf).alias("weight"), "df", (F.col("df") > common * index.n).alias("common")), small=True)
    got = weighted.toArrow()
    of: dict = {}
    for q, t, w, c in zip(*(got.column(x).to_pylist() for x in ("query_id", "token", "weight", "common"))):
        of.setdefault(q, []).append((t, w, c))
    weights = spark.sparkContext.broadcast(of)
    bounds = cut(heads.join(F.broadcast(weighted.select("query_id", F.col("token").alias("t"), "weight")), F.col("token") == F.col("t")).groupBy("query_id", "block").agg(F.sum(F.col("weight") * F.col("bound")).alias("bound")), small=True)
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    ranked = bounds.withColumn("place", F.row_number().over(order))
    low, size, both, most = 1, SEEDS, None, ranked.agg(F.max("place")).first()[0] or 0
    while low == 1 or low <= most:  # the blocks of the largest bounds first; what they give is the floor of the next ones, which are more
        now = ranked.filter((F.col("place") >= low) & (F.col("place") < low + size))
        if both is None:
            now = now.select("query_id", "block", F.lit(0.0).alias("floor"))
        else:
            nth = Window.partitionBy("query_id").orderBy(F.col("score").desc())
            floors = both.filter("score is not null").withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") == k).select("query_id", F.col("score").alias("floor"))
            now = now.join(floors, "query_id", "left").select("query_id", "block", "bound", F.coalesce("floor", F.lit(0.0)).alias("floor")).filter(F.col("bound") >= F.col("floor") - ROOM)
        got = cut(_score_blocks(index, wanted, now.select("query_id", "block", "floor"), weights, k), small=True)
        both = got if both is None else both.unionByName(got)
        low, size = low + size, size * GROWTH
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    hits = both.filter("score is not null").select("query_id", "id", "score", place.alias("rank")).filter(F.col("rank") <= k)
    total = weighted.groupBy("query_id").agg(F.sum("df").alias("postings"), F.sum(F.when(F.col("common"), F.col("df")).otherwise(0)).alias("common_postings"))
    done = both.groupBy("query_id").agg(F.sum("scored").alias("scored"), F.sum("scored_common").alias("common_scored"))
    return hits, total.join(done, "query_id", "left").na.fill(0, ["scored", "common_scored"]).select("query_id", "postings", "scored", "common_postings", "common_scored")
