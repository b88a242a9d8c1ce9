"""An inverted file with product quantisation: approximate cosine search over an index that is kept as tables.

Vectors of unit length are dealt to the nearest of some cells; what remains of each after its cell's centre is taken off is cut into pieces,
and each piece is written as the number of the nearest entry of that piece's book. ``build`` fits centres and books by k-means steps on Spark and
writes one row for each point: id, code, payload, in a folder a cell. ``search`` reads the folders of the cells nearest to its queries only,
scores codes, and compares the best of each query with their whole vectors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.operators.search import BLOCK, SLICE, payload_filter
from corvane.sources.tables import cut, spread_rows

#: Rows that centres and books are fitted on at most (those of the smallest id hashes), k-means steps, entries of a book, and cells at most.
SAMPLE, STEPS, ENTRIES, CELLS = 65_536, 8, 256, 4096
#: Components in a piece, the share of all codes that a query reads at least, and points of a query that are compared exactly.
PIECE, SCAN, EXACT = 4, 0.75, 100


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; ties go to the first."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 8192] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.empty(0, np.int64)


def _pieces(x: np.ndarray, pieces: int) -> np.ndarray:
    """Rows cut into pieces of equal length, filled up with zeros."""
    out = np.zeros((len(x), pieces * PIECE), np.float32)
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), pieces, PIECE).transpose(1, 0, 2)


def _means(rows: DataFrame, groups: int, assign) -> tuple[np.ndarray, np.ndarray]:
    """One k-means step on Spark: sums and counts of each slot, added up in each task first. assign: rows of a batch to (slots, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, np.zeros(groups, np.int64)
        for b in batches:
            if b.num_rows:
                slot, value = assign(b)
                total = np.zeros((groups, value.shape[1])) if total is None else total
                np.add.at(total, slot, value)
                n += np.bincount(slot, minlength=groups)
        if total is not None:
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.float64()))], ["slot", "n", "total"])

    got = rows.mapInArrow(run, "slot long, n long, total array<double>").toArrow()  # slots times tasks of the sample
    slot, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
    values = np.array(got.column("total").to_pylist(), np.float64).reshape(len(slot), -1)
    total, counts = np.zeros((groups, values.shape[1])), np.zeros(groups, np.int64)
    np.add.at(total, slot, values)
    np.add.at(counts, slot, n)
    return total, counts


def _moved(centres: np.ndarray, total: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """New centres; one that nothing is near to stays where it is."""
    return np.where(counts[:, None] > 0, total / np.maximum(counts, 1)[:, None], centres).astype(np.float32)


def fit(points: DataFrame, id_col: str, vec_col: str, cells: int | None = None, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(centres, books) by Lloyd's steps over a sample of at most SAMPLE rows."""
    spark = points.sparkSession
    n, width = points.agg(F.count(F.lit(1)), F.max(F.size(vec_col))).first()
    width = width or 1
    cells = cells or int(max(1, min(CELLS, round(n**0.5))))
    sample = cut(points.select(F.xxhash64(id_col).alias("h"), F.col(vec_col).alias("v")).orderBy("h").limit(SAMPLE).select("v").repartition(spark.sparkContext.defaultParallelism), small=True)
    rng = np.random.default_rng(seed)
    first = _vectors(sample.limit(max(cells, ENTRIES)).toArrow().column("v").combine_chunks(), width)
    pieces = -(-width // PIECE)
    if not len(first):
        return np.zeros((1, width), np.float32), np.zeros((pieces, 1, PIECE), np.float32)
    centres = first[np.arange(cells) % len(first)].copy()
    for _ in range(STEPS):
        shared = spark.sparkContext.broadcast(centres)

        def to_cells(b, shared=shared):
            x = _vectors(b.column(0), width)
            return nearest(x, shared.value), x

        centres = _moved(centres, *_means(sample, len(centres), to_cells))
    books = np.stack([_pieces(first - centres[nearest(first, centres)], pieces)[m][rng.permutation(len(first))[: min(ENTRIES, len(first))]] for m in range(pieces)])
    for _ in range(STEPS):
        shared = spark.sparkContext.broadcast((centres, books))

        def to_entries(b, shared=shared):
            c, book = shared.value
            x = _vectors(b.column(0), width)
            p = _pieces(x - c[nearest(x, c)], pieces)
            return np.concatenate([nearest(p[m], book[m]) + m * book.shape[1] for m in range(pieces)]), p.reshape(-1, PIECE)

        total, counts = _means(sample, pieces * books.shape[1], to_entries)
        books = _moved(books.reshape(-1, PIECE), total, counts).reshape(books.shape)
    return centres, books


def build(points: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", payload: tuple = (), cells: int | None = None) -> None:
    """An index of all points at ``path``: books, and codes in a folder a cell. Null vectors and ids are passed over; vectors without length are points of score 0."""
    spark, there = points.sparkSession, points.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull())
    centres, books = fit(there, id_col, vec_col, cells)
    shared, width, pieces = spark.sparkContext.broadcast((centres, books)), centres.shape[1], len(books)
    kept = [F.col(id_col).cast("long").alias("id"), *[F.col(c) for c in payload], F.col(vec_col).alias("v")]
    plain = spread_rows(there.select(*kept))
    names = ["id", *payload]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, book = shared.value
        for b in batches:
            x = _vectors(b.column(len(names)), width)
            cell = nearest(x, c)
            p = _pieces(x - c[cell], pieces)
            codes = np.stack([nearest(p[m], book[m]) for m in range(pieces)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(cell, pa.int32())], [*names, "code", "cell"])

    kinds = dict(plain.dtypes)
    codes = plain.mapInArrow(encode, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", code binary, cell int")
    # a cell may hold a third of all points: it is written by several tasks
    codes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", F.pmod(F.xxhash64("id"), F.lit(4))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")
    schema = spark.createDataFrame([(codes.schema.json(),)], "json string")  # an empty table leaves no file that would tell
    schema.coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    counts = {r.cell: r.n for r in spark.read.schema(codes.schema).parquet(f"{path}/codes").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a cell
    rows = [(0, i, c.tolist(), counts.get(i, 0)) for i, c in enumerate(centres)] + [(1 + m, e, v.tolist(), 0) for m in range(pieces) for e, v in enumerate(books[m])]
    spark.createDataFrame(rows, "book int, entry int, v array<float>, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/books")


class VectorIndex:
    """An index that was built at ``path``. Centres and books are read to the driver: CELLS and ENTRIES bound them."""

    def __init__(self, spark: SparkSession, path: str):
        self.codes = spark.read.schema(StructType.fromJson(json.loads(spark.read.parquet(f"{path}/schema").first().json))).parquet(f"{path}/codes")
        rows = spark.read.parquet(f"{path}/books").orderBy("book", "entry").collect()
        self.centres, self.sizes = np.array([r.v for r in rows if r.book == 0], np.float32), np.array([r.n for r in rows if r.book == 0], np.int64)
        per_book: dict = {}
        for r in rows:
            if r.book:
                per_book.setdefault(r.book, []).append(r.v)
        self.books, self.n = np.array([per_book[m] for m in sorted(per_book)], np.float32), int(self.sizes.sum())


def search(index: VectorIndex, points: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "vec_id", query_vec: str = "embedding", scan: float = SCAN, exact: int = EXACT, conditions: dict | None = None, threshold: float | None = None, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank, scanned, compared): approximate nearest points by cosine.

    A query reads the cells nearest to it until they hold the share ``scan`` of all points, scores their codes, and compares the best ``exact`` (at most a tenth of all
    points, but k at least) with the vectors of ``points``. ``conditions`` (see payload_filter) hold for columns stored as payload and reach the scan of the codes; ``threshold``
    is for exact scores. scanned and compared: codes and whole vectors that the query met. Queries go in blocks of BLOCK; a cell's codes are dealt to several tasks.
    """
    spark = points.sparkSession
    best_of = max(k, min(exact, index.n // 10))
    width, pieces, shared = index.centres.shape[1], len(index.books), spark.sparkContext.broadcast((index.centres, index.books))
    qs = cut(queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vec).alias("v")).filter("v is not null"), small=True)
    blocks, parts = max(1, -(-qs.count() // BLOCK)), []
    for block in range(blocks):
        got = (qs if blocks == 1 else qs.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).orderBy("query_id").toArrow()
        if not got.num_rows:
            continue
        ids, q = got.column("query_id").to_numpy(), _vectors(got.column("v").combine_chunks(), width)
        order = np.argsort(-(q @ index.centres.T), axis=1, kind="stable")
        enough = np.cumsum(index.sizes[order], axis=1)
        probed = np.c_[np.zeros(len(q), bool), enough[:, :-1] >= scan * index.n]  # cells after the first that make it enough
        wanted = np.zeros((len(q), len(index.centres)), bool)
        np.put_along_axis(wanted, order, ~probed, 1)
        asked = spark.sparkContext.broadcast((ids, q, wanted))
        cells = [int(c) for c in np.flatnonzero(wanted.any(axis=0) & (index.sizes > 0))]

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            (centres, books), (qid, q, wanted) = shared.value, asked.value
            best = [(np.empty(0), np.empty(0, np.int64)) for _ in qid]
            met = np.zeros(len(qid), np.int64)
            for b in batches:
                at, cell = b.column(0).to_numpy(), b.column(2).to_numpy()
                codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(at), pieces) if len(at) else np.empty((0, pieces), np.uint8)
                for c in np.unique(cell):
                    its, asks = np.flatnonzero(cell == c), np.flatnonzero(wanted[:, c])
                    met[asks] += len(its)
                    for rows, who in ((its[i : i + SLICE[1]], asks[j : j + SLICE[0]]) for i in range(0, len(its), SLICE[1]) for j in range(0, len(asks), SLICE[0])):
                        # the product with decoded codes is what adding up tables of distances gives, for many queries of the cell at once
                        near = centres[c] + np.concatenate([books[m][codes[rows, m]] for m in range(pieces)], axis=1)[:, :width]
                        s = q[who] @ near.T
                        if len(rows) > best_of:
                            keep = np.argpartition(-s, best_of - 1, axis=1)[:, :best_of]
                            s, near_ids = np.take_along_axis(s, keep, 1), at[rows][keep]
                        else:
                            near_ids = np.broadcast_to(at[rows], s.shape)
                        for i, w in enumerate(who):
                            score, ident = np.concatenate([best[w][0], s[i]]), np.concatenate([best[w][1], near_ids[i]])
                            first = np.lexsort((ident, -score))[:best_of]
                            best[w] = score[first], ident[first]
            n = [len(x) for _, x in best]
            if sum(n):
                first = np.r_[0, np.cumsum(n)[:-1]]
                scanned = np.zeros(sum(n), np.int64)
                scanned[first[np.array(n) > 0]] = met[np.array(n) > 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n)), pa.array(np.concatenate([x for _, x in best])), pa.array(np.concatenate([x for x, _ in best]).astype(np.float64)), pa.array(scanned)], ["query_id", "id", "near", "scanned"])

        parts.append(payload_filter(index.codes.filter(F.col("cell").isin(cells)), conditions).select("id", "code", "cell").mapInArrow(run, "query_id long, id long, near double, scanned long"))
    if not parts:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int, scanned long, compared long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    window = Window.partitionBy("query_id")
    short = found.withColumn("place", F.row_number().over(window.orderBy(F.col("near").desc(), "id"))).withColumn("scanned", F.sum("scanned").over(window)).filter(F.col("place") <= best_of).select("query_id", "id", "scanned").distinct()  # rows that repeat an id meet all its vectors once
    whole = short.join(points.select(F.col(id_col).cast("long").alias("pid"), F.col(vec_col).alias("pv")), F.col("id") == F.col("pid")).join(F.broadcast(qs.select(F.col("query_id").alias("qid"), F.col("v").alias("qv"))) if blocks == 1 else qs.select(F.col("query_id").alias("qid"), F.col("v").alias("qv")), F.col("query_id") == F.col("qid"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, q = (_unit(b.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)) if b.num_rows else np.zeros((0, 1)) for i in (3, 4))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.round((p * q).sum(axis=1), digits) + 0.0)], ["query_id", "id", "scanned", "score"])

    scored = whole.select("query_id", "id", "scanned", "pv", "qv").mapInArrow(compare, "query_id long, id long, scanned long, score double").withColumn("compared", F.count(F.lit(1)).over(window))
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    return scored.withColumn("rank", F.row_number().over(window.orderBy(F.col("score").desc(), "id"))).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank", "scanned", "compared")
