"""Hard-negative mining by a search over buckets of like norm.

Candidates are sorted by norm, longest first, and cut into buckets. A bucket's largest norm times an anchor's norm bounds every score in it
(Cauchy-Schwarz), so a bucket is passed over for an anchor as soon as that bound is below what each of the anchor's windows
asks for: the window's lower limit, or the score of the k-th row found so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import shuffle_partitions, stored
from corvane.sources.tables import spread_rows

#: Candidates in a bucket, and anchors that are sent to all tasks at a time: both have a fixed size, whatever the input's.
BUCKET, ANCHORS = 1024, 16_384
#: Parts of the sorted candidates searched in the first round, for each core; each later round takes so many times as many.
FIRST, GROWTH = 4, 8
NO_ID = np.iinfo(np.int64).max
#: Below every score: a place not taken.
NONE = np.iinfo(np.int64).min + 1


def _matrix(vectors: list[bytes], kind: str, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    out = np.zeros((len(vectors), width), np.dtype(kind))
    for i, v in enumerate(vectors):
        row = np.frombuffer(v, kind)
        out[i, : len(row)] = row
    return out


def arithmetic(bound: float) -> str:
    """The fastest kind of numbers in which sums of products below ``bound`` are exact."""
    return "<f4" if bound < 1 << 24 else "<f8" if bound < 1 << 53 else "O"


def products(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    """Exact integer inner products. ``kind`` O: as integers of any size, held within the range of a long."""
    if kind != "O":
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    return np.clip(exact, NONE + 1, NO_ID).astype(np.int64) if exact.size else np.zeros(exact.shape, np.int64)


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(row, id, label, v, norm, top, n): vectors as packed doubles of floor(scale * x), their norm, largest component and length.

    Rows with a null label, a null vector or a component that is null or not finite take no part. ``row`` tells rows with the same id apart:
    it numbers the input's rows before anything is dealt.
    """
    plain = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(3)
            flat, n = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64), x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.floor(flat * scale) + 0.0
            ends = np.cumsum(n)
            good = np.array([bool(np.isfinite(flat[e - k : e]).all()) for e, k in zip(ends, n)], bool)
            keep = np.flatnonzero(good)
            parts = [flat[ends[i] - n[i] : ends[i]] for i in keep]
            b = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([float(np.sqrt((p * p).sum())) for p in parts], pa.float64()), pa.array([float(np.abs(p).max(initial=0)) for p in parts], pa.float64()), pa.array(n[keep], pa.int64())], ["row", "id", "label", "v", "norm", "top", "n"])

    rows = spread_rows(plain.filter("label is not null and x is not null"))
    return rows.mapInArrow(run, "row long, id long, label long, v binary, norm double, top double, n long")


def norm_buckets(vectors: DataFrame, kind: str, width: int, parts: int) -> DataFrame:
    """(part, bucket, norm, rows, ids, labels, v): candidates sorted by norm, longest first, in buckets of BUCKET rows; norm is the bucket's largest.

    Equal norms are told apart by id and row, so no norm is too frequent for a part. Within a bucket rows go by label, then id."""
    order = F.col("norm").desc(), F.col("id").asc_nulls_last(), F.col("row")
    dealt = vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, bucket = [], 0, 0

        def made(t: pa.Table) -> pa.RecordBatch:
            rows, ids, labels = t.column("row").to_numpy(), t.column("id").fill_null(NO_ID).to_numpy(), t.column("label").to_numpy()
            at = np.lexsort((rows, ids, labels))
            v = _matrix([t.column("v")[int(i)].as_py() for i in at], "<f8", width).astype(kind)
            packed = [x[at].astype("<i8").tobytes() for x in (rows, ids, labels)] + [v.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([t.column("part")[0].as_py()], pa.int32()), pa.array([bucket], pa.int32()), pa.array([t.column("norm")[0].as_py()], pa.float64()), *[pa.array([x], pa.binary()) for x in packed]], ["part", "bucket", "norm", "rows", "ids", "labels", "v"])

        for b in batches:
            waiting.append(b)
            n += b.num_rows
            while n >= BUCKET:
                t = pa.Table.from_batches(waiting)
                yield made(t.slice(0, BUCKET))
                bucket += 1
                waiting, n = t.slice(BUCKET).to_batches(), n - BUCKET
        if n:
            yield made(pa.Table.from_batches(waiting))

    return dealt.mapInArrow(pack, "part int, bucket int, norm double, rows binary, ids binary, labels binary, v binary")


def better(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each line, higher scores first, ties by smaller id, then row."""
    order = np.lexsort((rows, ids, -scores), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (scores, ids, rows))


class Best:
    """The k best rows found so far for each window."""

    def __init__(self, windows: int, k: int):
        self.scores, self.ids, self.rows = np.full((windows, k), NONE, np.int64), np.full((windows, k), NO_ID, np.int64), np.full((windows, k), NO_ID, np.int64)

    def least(self) -> np.ndarray:
        """What a row must score at least to get in."""
        return self.scores[:, -1]

    def offer(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Rows for the windows ``which``, whose scores (one line a window, NONE for rows that don't count) may get in. Columns are in the order of ties."""
        k = self.scores.shape[1]
        some = scores.max(axis=1, initial=NONE) >= np.maximum(self.least()[which], NONE + 1)
        which, scores = which[some], scores[some]
        if not len(which):
            return
        n = scores.shape[1]
        if n > k:  # the first k of each line: ties by place, which is the order of ids within a label's rows
            order = np.lexsort((np.broadcast_to(rows, scores.shape), np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k] if n <= 4 * k else self._first(scores, ids, rows, k)
            scores = np.take_along_axis(scores, order, 1)
            ids, rows = ids[order], rows[order]
        else:
            ids, rows = np.broadcast_to(ids, scores.shape), np.broadcast_to(rows, scores.shape)
        taken = scores > NONE
        ids, rows = np.where(taken, ids, NO_ID), np.where(taken, rows, NO_ID)
        both = [np.concatenate([x[which], y], axis=1) for x, y in ((self.scores, scores), (self.ids, ids), (self.rows, rows))]
        self.scores[which], self.ids[which], self.rows[which] = better(*both, k)

    @staticmethod
    def _first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """Columns of the first k of each line. Lines whose k-th score is shared by other rows are sorted whole."""
        n = scores.shape[1]
        order = np.argpartition(scores, n - k - 1, axis=1)
        kth = np.take_along_axis(scores, order[:, n - k :], 1).min(axis=1)
        rest = np.take_along_axis(scores, order[:, n - k - 1 : n - k], 1)[:, 0]
        out = order[:, n - k :]
        for i in np.flatnonzero((rest == kth) & (kth > NONE)):
            out[i] = np.lexsort((rows, ids, -scores[i]))[:k]
        return out


def search(buckets: DataFrame, block: pa.Table, k: int, bound: float, same_label: bool, width: int, kind: str) -> DataFrame:
    """(anchor_row, place, id, row, score): of each part of ``buckets``, the k best rows of each window of a block of anchors.

    block: row, id, label, norm, v, and for windows place, low, high and least (the k-th score known from other parts), one line a window.
    Windows of an anchor lie together. ``same_label``: rows of the anchor's label but not the anchor itself; else those of other labels.
    """
    columns = {c: block.column(c).to_numpy() for c in ("row", "label", "norm", "place", "low", "high", "least")}
    first = np.flatnonzero(np.r_[True, columns["row"][1:] != columns["row"][:-1]])
    v = _matrix([block.column("v")[int(i)].as_py() for i in first], "<f8", width).astype(kind)
    owner = np.cumsum(np.r_[False, columns["row"][1:] != columns["row"][:-1]])
    shared = buckets.sparkSession.sparkContext.broadcast((columns, first, owner, v))
    exact = arithmetic(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, first, owner, anchors = shared.value
        best = Best(len(owner), k)
        norms, labels, own = c["norm"][first], c["label"][first], c["row"][first]
        for b in batches:
            for norm, rows, ids, tags, v in zip(*(b.column(x).to_pylist() for x in ("norm", "rows", "ids", "labels", "v"))):
                rows, ids, tags = (np.frombuffer(x, "<i8") for x in (rows, ids, tags))
                need = np.maximum(np.maximum(c["low"], c["least"]), best.least())
                # one part in a thousand million stands for what the bound's own rounding may lose
                alive = np.flatnonzero(norm * norms[owner] * (1 + 1e-9) + 1 >= need)
                if not len(alive):
                    continue
                v = np.frombuffer(v, kind).reshape(len(rows), width)
                starts = np.flatnonzero(np.r_[True, tags[1:] != tags[:-1]])
                groups = list(zip(tags[starts], starts, np.r_[starts[1:], len(tags)])) if same_label else [(None, 0, len(tags))]
                for tag, x, y in groups:
                    which = alive[labels[owner[alive]] == tag] if same_label else alive
                    if not len(which):
                        continue
                    who, back = np.unique(owner[which], return_inverse=True)
                    s = products(anchors[who], v[x:y], exact)
                    mark = rows[x:y][None] == own[who][:, None] if same_label else tags[None] == labels[who][:, None]
                    s[mark] = NONE
                    for place in np.unique(c["place"][which]):  # each window of an anchor has its own limits
                        at = np.flatnonzero(c["place"][which] == place)
                        w, lines = which[at], s[back[at]]
                        fits = (lines >= np.maximum(need[w], NONE + 1)[:, None]) & (lines <= c["high"][w][:, None])
                        some = fits.any(axis=1)
                        if some.any():
                            best.offer(w[some], np.where(fits[some], lines[some], NONE), ids[x:y], rows[x:y])
        w, place = np.nonzero(best.scores > NONE)
        if len(w):
            found = best.ids[w, place]
            yield pa.RecordBatch.from_arrays([pa.array(c["row"][w]), pa.array(c["place"][w], pa.int32()), pa.array(found, mask=found == NO_ID), pa.array(best.rows[w, place]), pa.array(best.scores[w, place])], ["anchor_row", "place", "id", "row", "score"])

    return buckets.mapInArrow(run, "anchor_row long, place int, id long, row long, score long")


def searched(buckets: DataFrame, windows: DataFrame, k: int, bound: float, same_label: bool, width: int, kind: str) -> DataFrame:
    """(anchor_row, place, id, row, score, rank): the k best candidates of each window, found in rounds over the parts of the buckets and in blocks of anchors.

    The first round takes few parts; the k-th scores it finds are limits of the next one, which takes more: so a window's rows that leave a
    task grow with the number of rounds, not with the number of parts. A round whose norms are too small for every window ends the search.
    """
    spark = buckets.sparkSession
    reach = {r.part: r.norm for r in buckets.groupBy("part").agg(F.max("norm").alias("norm")).collect()}  # a number for each part
    parts, n = max(reach, default=-1) + 1, windows.select("row").distinct().count()
    blocks = max(1, -(-n // ANCHORS))
    order = Window.partitionBy("anchor_row", "place").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row"))
    out = []
    for i in range(blocks):
        block = windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i)
        low, size, found = 0, FIRST * spark.sparkContext.defaultParallelism, None
        while low < parts:
            least = F.lit(int(NONE)).cast("long")
            if found is not None:
                kth = found.filter(F.col("rank") == k).select(F.col("anchor_row").alias("ar"), F.col("place").alias("pl"), F.col("score").alias("kth"))
                block_now = block.join(kth, (F.col("row") == F.col("ar")) & (F.col("place") == F.col("pl")), "left").withColumn("least", F.coalesce("kth", least)).drop("ar", "pl", "kth")
            else:
                block_now = block.withColumn("least", least)
            here = [reach[p] for p in range(low, min(parts, low + size)) if p in reach]
            if here:
                need = F.greatest(F.col("low"), F.col("least"))
                got = block_now.filter(F.col("norm") * F.lit(max(here) * (1 + 1e-9)) + 1 >= need).orderBy("row", "place").toArrow()
                if got.num_rows:
                    more = search(buckets.filter((F.col("part") >= low) & (F.col("part") < low + size)), got, k, bound, same_label, width, kind)
                    both = more if found is None else more.unionByName(found.drop("rank"))
                    found = stored(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
            low, size = low + size, size * GROWTH
        if found is not None:
            out.append(found)
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "anchor_row long, place int, id long, row long, score long, rank int")


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for rows whose id is divisible by ``every``.

    Vectors are quantised to floor(scale * x); scores are integer inner products, shorter vectors being filled up with zeros. An anchor's
    positives are the first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels are returned whose
    score lies between ``low`` and ``high`` percent of the positive's. Higher scores come first, ties by smaller id (null ids
    last), then by place in the table. Null labels, null vectors, null or non-finite components: the row takes no part. Null ids are
    candidates, not anchors. Repeated ids are rows of their own. Scores beyond the range of a long stay at its ends. An empty table gives none.
    """
    vectors = stored(quantised(df, id_col, vec_col, label_col, scale))
    most = vectors.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("width"), F.max("norm").alias("norm"), F.max("top").alias("top")).first()
    width, top = int(most.width or 0), float(most.top or 0.0)
    kind = "<i2" if top < 1 << 15 else "<f8"
    bound = float(most.norm or 0.0) ** 2 * (1 + 1e-9) + 1
    parts = int(max(1, min(-(-most.n // BUCKET), 64 * shuffle_partitions(df.sparkSession))))
    buckets = stored(norm_buckets(vectors, kind, width, parts))
    anchors = vectors.filter(F.pmod("id", F.lit(every)) == 0).select("row", "id", "label", "norm", "v")
    whole = anchors.withColumn("place", F.lit(0)).withColumn("low", F.lit(int(NONE)).cast("long")).withColumn("high", F.lit(int(NO_ID)).cast("long"))
    near = searched(buckets, whole, positives, bound, True, width, kind).withColumnRenamed("id", "positive_id").withColumnRenamed("score", "positive_score")
    near = near.select(F.col("anchor_row").alias("ar"), F.col("rank").alias("place"), "positive_id", "positive_score")
    # percentages of whole numbers, rounded inwards; products that leave the range of a long are taken as decimals
    p = F.col("positive_score").cast("decimal(28,0)")
    pairs = near.withColumn("low", F.ceil(p * low / 100).cast("long")).withColumn("high", F.floor(p * high / 100).cast("long"))
    windows = stored(anchors.join(pairs, F.col("row") == F.col("ar")).filter("low <= high").select("row", "id", "label", "norm", "v", "place", "low", "high"))
    found = searched(buckets, windows, negatives, bound, False, width, kind).select(F.col("anchor_row").alias("fr"), F.col("place").alias("fp"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    out = found.join(near, (F.col("fr") == F.col("ar")) & (F.col("fp") == F.col("place"))).join(anchors.select("row", F.col("id").alias("anchor_id")), F.col("fr") == F.col("row"))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def relabelled(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", every: int = 7, labels: int = 10) -> DataFrame:
    """Where the id is divisible by ``every`` the label becomes the next of ``labels``."""
    return df.withColumn(label_col, F.when(F.pmod(F.col(id_col), F.lit(every)) == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col)))
