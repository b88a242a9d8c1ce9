"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut


#: Nodes with more than one in so many of all edges are joined by broadcast: there are at most twice as many of them.
HEAVY_SHARE, HEAVY_LEAST = 10_000, 200
#: Edges that a task reduces to a forest at once, some tens of MB; roots that are broadcast at most.
AT_ONCE, BROADCAST_ROOTS = 1 << 19, 500_000


def _with_least(pairs: DataFrame, count: int) -> DataFrame:
    """pairs (a, b) to (a, b, m): m is the smallest b of each a.

    Minima are aggregated map-side. The few nodes that hold a large share of all edges meet their minimum by a broadcast, whose size
    HEAVY_SHARE bounds, and are never dealt to one task; all others by a join.
    """
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("a", "k")
    many = max(HEAVY_LEAST, count // HEAVY_SHARE)
    heavy = F.broadcast(least.filter(F.col("n") > many).select(F.col("k").alias("hk"), F.col("m").alias("hm")))
    light = least.filter(F.col("n") <= many).select("k", "m")
    marked = pairs.join(heavy, F.col("a") == F.col("hk"), "left")
    hot = marked.filter("hk is not null").select("a", "b", F.col("hm").alias("m"))
    return hot.unionByName(marked.filter("hk is null").join(light, F.col("a") == F.col("k")).select("a", "b", "m"))


def _forests(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (a, b): each node of at most AT_ONCE edges of a partition with the smallest node that it reaches over these; roots stand with themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []

        def forest() -> Iterator[pa.RecordBatch]:
            ends = np.concatenate(parts, axis=1)
            parts.clear()
            nodes, at = np.unique(ends.ravel(), return_inverse=True)
            x, y = at.reshape(2, -1)
            root = local_components(len(nodes), x, y)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["a", "b"])

        for batch in batches:
            if parts and sum(p.shape[1] for p in parts) + batch.num_rows > AT_ONCE:
                yield from forest()
            if batch.num_rows:
                parts.append(np.stack([batch.column(k).to_numpy() for k in range(2)]))
        if parts:
            yield from forest()

    return edges.mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs to (node, root): root is the smallest node that can be reached.

    Tasks reduce their edges to forests of stars, AT_ONCE edges at a time. A node that has roots in several forests, or is itself a
    root in one, ties these roots to the smallest of them; the components of such ties, of which there are far fewer, are found
    in the same way, in as few tasks as AT_ONCE allows, or, where forests don't halve the edges, by :func:`star_rounds`. No node's
    neighbours are gathered, only its roots, one a forest; the driver sees counts. Only nodes that have edges appear. Null ends and loops are ignored.
    """
    own = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return _components(own, max(2, edges.sparkSession.sparkContext.defaultParallelism), most_rounds)


def _components(edges: DataFrame, tasks: int, most_rounds: int) -> DataFrame:
    """:func:`connected_components` of edges without nulls; loops may stand among them."""
    stars = cut(_forests(edges.coalesce(tasks)))
    rooted = cut(stars.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("all")), small=True)
    ties = rooted.select(F.explode("all").alias("a"), F.col("m").alias("b")).filter("a <> b")
    many = ties.count()
    if not many:
        return rooted.select(F.col("a").alias("node"), F.col("m").alias("root"))
    if many <= AT_ONCE:
        top = cut(_forests(ties.coalesce(1))).toDF("node", "root")
    elif many <= stars.count() // 2:
        top = cut(_components(ties, -(-many // AT_ONCE), most_rounds), small=True)
    else:
        top = cut(star_rounds(ties, most_rounds), small=True)
    top = F.broadcast(top) if top.count() <= BROADCAST_ROOTS else top
    return rooted.join(top, F.col("m") == F.col("node"), "left").select(F.col("a").alias("node"), F.coalesce("root", "m").alias("root"))


def star_rounds(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """:func:`connected_components` by rounds of joins, for edges of which forests leave most.

    Alternates large-star and small-star steps, in which each node hands its neighbours its
    smallest neighbour, until the edges are stars. No node's neighbours are gathered; each
    round's edges are cut with a checkpoint; the driver sees one count and one checksum a round. Not to be done after ``most_rounds`` is an error.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), small=True)
    state = lambda: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = state()
    for done in range(most_rounds if seen[0] else 0):
        large = _with_least(e.union(e.select("b", "a")), seen[0]).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        small = _with_least(large, seen[0])
        e = cut(small.select("a", "m").union(small.filter("b <> m").select("b", "m")).distinct().toDF("a", "b"), small=True)
        now = state()
        if now == seen:
            break
        if done == most_rounds - 1:
            raise RuntimeError(f"components are not found after {most_rounds} rounds")
        seen = now
    return e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges (a, b), within one task."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
