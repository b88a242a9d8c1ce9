"""SimHash fingerprints and exact search of all pairs within a Hamming radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import cut, shuffle_partitions, taking_part
from corvane.llm.components import connected_components, local_components

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints in a tile that is compared at once; in a tile that is dealt; fingerprints (each counted once a block) a task; rows of the table of dealt tiles that are broadcast at most.
TILE, HEAVY, PER_TASK, BROADCAST_TILES = 256, 16384, 400_000, 500_000
#: Dense groups (class, part of a class) that are broadcast at most, a few MB; more are joined.
BROADCAST_GROUPS = 100_000


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included; A-Z lower-cased; fewer words count as one shingle."""
    words = text.lower().split()  # A-Z only; splits at the six ASCII white-space characters
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, max(1, len(words) - shingle + 1))


def simhash(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):  # bounded memory for very long texts
        part = h[at : at + 65536]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text; 0 if it has no words."""
    return simhash(shingle_hashes(text, shingle))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp as a signed long. Null text counts as empty; null ids, ties and repeated rows stay; other columns are not carried, so names never clash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    plain = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    return plain.mapInArrow(run, f"id {dict(plain.dtypes)['id']}, fp long")


def tiled_links(fps: np.ndarray, radius: int, group: np.ndarray | None = None, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as two index arrays) of the pairs of fps within the radius: of all pairs in one group, and of some others.

    Fingerprints stand in order of group and population count and are cut into tiles. Two tiles are compared by exclusive-or and bit counts, unless
    they have no group in common or their population counts differ by more than the radius, which bounds the distance from below. Each tile pair is reduced to a forest at once.
    """
    pop = np.bitwise_count(fps)
    group = np.zeros(len(fps), np.int64) if group is None else group
    order = np.lexsort((pop, group))
    f, p, g = fps[order], pop[order].astype(np.int16), group[order]
    cuts = [*range(0, len(f), tile), len(f)]
    ends_a, ends_b = [], []
    for i in range(len(cuts) - 1):
        a0, a1 = cuts[i], cuts[i + 1]
        for j in range(i, len(cuts) - 1):
            b0, b1 = cuts[j], cuts[j + 1]
            if g[b0] > g[a1 - 1] or g[b0] == g[a1 - 1] and p[b0] - p[a1 - 1] > radius:
                break
            near = np.bitwise_count(f[a0:a1, None] ^ f[None, b0:b1]) <= radius
            x, y = np.nonzero(near)
            x, y = x + a0, y + b0
            x, y = x[x < y], y[x < y]
            if len(x) > 2 * tile:
                at = np.concatenate([np.arange(a0, a1), np.arange(b0, b1)]) if j > i else np.arange(a0, a1)
                where = lambda v: np.where(v < a1, v - a0, v - b0 + (a1 - a0)) if j > i else v - a0  # noqa: B023, E731
                root = local_components(len(at), where(x), where(y))
                move = np.nonzero(root != np.arange(len(at)))[0]
                x, y = at[root[move]], at[move]
            ends_a.append(x)
            ends_b.append(y)
    a, b = np.concatenate(ends_a or [np.empty(0, np.int64)]), np.concatenate(ends_b or [np.empty(0, np.int64)])
    root = local_components(len(f), a, b)
    move = np.nonzero(root != np.arange(len(f)))[0]
    return order[root[move]], order[move]


def dealt_tiles(spots: DataFrame, radius: int) -> tuple[DataFrame, int]:
    """spots (fp, key, pop) to (fp, key, sub), a row for each pair of tiles that a fingerprint takes part in, and the number of spots.

    The fingerprints of one block value, in order of population count, are cut into tiles of HEAVY; equal counts are cut by a hash. Tile pairs whose
    population counts differ by more than the radius are left out. Most values have one tile, which is compared with itself.
    """
    cells = cut(spots.groupBy("key", "pop").agg(F.count(F.lit(1)).alias("n")), small=True)
    total = cells.agg(F.sum("n")).first()[0] or 0
    large = cells.join(cells.groupBy("key").agg(F.sum("n").alias("all")).filter(F.col("all") > HEAVY).select("key"), "key", "left_semi")
    before = F.sum("n").over(Window.partitionBy("key").orderBy("pop")) - F.col("n")
    tiles = large.select("key", "pop", F.floor(before / HEAVY).cast("int").alias("low"), F.floor((before + F.col("n") - 1) / HEAVY).cast("int").alias("high"))
    spans = tiles.select("key", "pop", F.explode(F.sequence("low", "high")).alias("tile")).groupBy("key", "tile").agg(F.min("pop").alias("from"), F.max("pop").alias("to"))
    lists = spans.groupBy("key").agg(F.collect_list(F.struct("tile", "from", "to")).alias("tiles"))
    tiles = cut(tiles.join(lists, "key").select(F.col("key").alias("k"), F.col("pop").alias("p"), "low", "high", "tiles"), small=True)
    rows = tiles.count()
    if not rows:
        return spots.select("fp", "key", F.lit(0).alias("sub")), total
    mine = F.col("low") + F.pmod(F.xxhash64("fp"), F.col("high") - F.col("low") + 1).cast("int")
    joined = spots.join(F.broadcast(tiles) if rows <= BROADCAST_TILES else tiles, (F.col("key") == F.col("k")) & (F.col("pop") == F.col("p")), "left").withColumn("mine", mine)
    own = F.get(F.filter("tiles", lambda t: t["tile"] == F.col("mine")), F.lit(0))
    near = F.filter("tiles", lambda t: (t["from"] - own["to"] <= radius) & (own["from"] - t["to"] <= radius))
    subs = F.transform(near, lambda t: F.least(F.col("mine"), t["tile"]) * F.lit(1 << 15) + F.greatest(F.col("mine"), t["tile"]))
    return joined.select("fp", "key", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(subs)).alias("sub")), total


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct (fp) to edges (a, b) that connect all fingerprints within the radius.

    Two fingerprints within the radius agree on one of radius + 1 blocks of bits, so comparing all
    fingerprints that share a block's value misses no pair. Those of each value are dealt as pairs of tiles in order of population count
    (:func:`dealt_tiles`), so that no task gets an unbounded group; a task compares what it gets by :func:`tiled_links`.
    """
    spark = distinct.sparkSession
    blocks = radius + 1
    width = 64 // blocks
    assert width >= 16 or blocks <= 8
    mask = (1 << width) - 1
    key = F.explode(F.array(*[F.lit(i) * F.lit(1 << width) + F.shiftrightunsigned(F.col("fp"), i * width).bitwiseAND(F.lit(mask)) for i in range(blocks)])).alias("key")
    dealt, total = dealt_tiles(distinct.select("fp", key).withColumn("pop", F.bit_count("fp")), radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        fp, key, sub = (t.column(c).to_numpy() for c in ("fp", "key", "sub"))
        fp = fp.view(np.uint64)
        order = np.lexsort((sub, key))
        k, s = key[order], sub[order]
        group = np.empty(len(fp), np.int64)
        group[order] = np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
        x, y = tiled_links(fp, radius, group)
        yield pa.RecordBatch.from_arrays([pa.array(fp[v].view(np.int64), pa.int64()) for v in (x, y)], ["a", "b"])

    n = max(shuffle_partitions(spark), -(-total // PER_TASK))
    return dealt.repartition(n, "key", "sub").mapInArrow(run, "a long, b long")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id among all rows whose fingerprints can be reached over steps of
    at most ``radius`` differing bits. Rows of equal fingerprint are one node, whatever their number.

    Null text counts as empty; texts without words have fingerprint zero and link like any other. Null ids
    take part; a component's id is null only if all its rows lack one. Rows repeating an id are all
    returned. An empty table gives an empty result. Other columns are not carried.
    """
    rows = cut(fingerprints(df, id_col, text_col, shingle))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")), small=True)
    linked = connected_components(links(nodes.select("fp"), radius))
    labelled = nodes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of = labelled.select(F.col("fp").alias("f"), F.col("root").alias("r")).join(named, F.col("r") == F.col("root")).select("f", "component_id")
    return rows.join(of, F.col("fp") == F.col("f")).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near duplicates: words in a shingle, least Jaccard similarity of the shingle sets, and differing bits within which pairs are verified.
#: Texts of similarity 0.8 differ in 9.7 bits on average, 95 in 100 in 14 at most, 999 in 1000 in 20; more alike texts in fewer.
NEAR_SHINGLE, SIMILARITY, NEAR_RADIUS = 5, 0.8, 20
#: Keys of a text, and min-hashes in each. Of pairs of similarity s, (1 - s ** IN_KEY) ** KEYS have no key in common: 3 in a million at 0.8.
KEYS, IN_KEY = 24, 4
_ODD = np.random.default_rng(SEED).integers(0, 2**63, KEYS * IN_KEY, np.uint64) * np.uint64(2) + np.uint64(1)


#: Edges of a dense group are thinned to so many spanning forests without common edges once they outnumber the nodes by the second figure.
FORESTS, DENSE = 4, 8


def spanning_edges(n: int, x: np.ndarray, y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of edges (x, y) that connect what all edges connect, those of fewer bits first: at most two for each node and distance."""
    root, chosen = np.arange(n), []
    for d in np.unique(bits):
        at = np.flatnonzero(bits == d)
        while len(at):
            a, b = root[x[at]], root[y[at]]
            at, a, b = at[a != b], a[a != b], b[a != b]
            if not len(at):
                break
            _, first = np.unique(np.concatenate([a, b]), return_index=True)  # an edge for each part
            take = np.unique(first % len(at))
            chosen.append(at[take])
            root = local_components(n, np.concatenate([a[take], np.arange(n)]), np.concatenate([b[take], root]))
    return np.concatenate(chosen) if chosen else np.empty(0, np.int64)


def thinned(n: int, x: np.ndarray, y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of the edges to keep: all, or FORESTS spanning forests of a dense group."""
    at = np.arange(len(x))
    if len(x) <= DENSE * len(np.unique(np.concatenate([x, y]))):
        return at
    kept = []
    for _ in range(FORESTS):
        take = spanning_edges(n, x[at], y[at], bits[at])
        kept.append(at[take])
        at = np.delete(at, take)
    return np.concatenate(kept)


#: Most bits of a parity sketch, and pairs whose sketches are compared at once.
SKETCH_BITS, PAIRS = 1024, 1 << 16


def near_keys(h: np.ndarray) -> np.ndarray:
    """KEYS hashes, each of IN_KEY min-hashes of a set of hashes: texts with a key in common are compared."""
    least = np.full(KEYS * IN_KEY, (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), 2048):
        np.minimum(least, (h[None, at : at + 2048] * _ODD[:, None]).min(axis=1), out=least)
    least ^= least >> np.uint64(32)
    key = np.arange(1, KEYS + 1, dtype=np.uint64) * _ODD[:KEYS]
    for part in least.reshape(KEYS, IN_KEY).T:
        key = (key ^ part) * _ODD[0]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def parity_sketch(h: np.ndarray) -> bytes:
    """A bit for each remainder of a set of hashes, set if an odd number of them has it: two bits or more a hash, up to SKETCH_BITS.

    Sketches of two sets differ in no more bits than the sets differ in hashes; halves of a sketch combined by exclusive-or are the sketch of half as many bits.
    """
    bits = min(SKETCH_BITS, max(64, 1 << (2 * len(h) - 1).bit_length())) if len(h) else 64
    counts = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Parity sketches as rows, folded to the shortest among them."""
    width = min(map(len, sketches), default=8) // 8
    out = np.empty((len(sketches), width), np.uint64)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, width), axis=0)
    return out


def near_edges(fps: np.ndarray, sizes: np.ndarray, upper: np.ndarray, sketches: np.ndarray, radius: int, similarity: float, root: np.ndarray | None = None, tile: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, bits) of the pairs within the radius whose sizes and parity sketches allow the similarity, a block for each two tiles as in :func:`tiled_links`.

    ``upper`` rows are not compared with each other, nor are rows of one ``root``. No pair of the similarity within the radius is left out.
    """
    pop = np.bitwise_count(fps)
    order = np.argsort(pop, kind="stable")
    f, p, s, u = fps[order], pop[order].astype(np.int16), sizes[order].astype(np.float64), upper[order]
    cuts = [*range(0, len(f), tile), len(f)]
    for i in range(len(cuts) - 1):
        a0, a1 = cuts[i], cuts[i + 1]
        for j in range(i, len(cuts) - 1):
            b0, b1 = cuts[j], cuts[j + 1]
            if p[b0] - p[a1 - 1] > radius:
                break
            bits = np.bitwise_count(f[a0:a1, None] ^ f[None, b0:b1])
            x, y = np.nonzero(bits <= radius)
            d = bits[x, y]
            x, y = x + a0, y + b0
            ok = (x < y) & ~(u[x] & u[y]) & (np.minimum(s[x], s[y]) >= similarity * np.maximum(s[x], s[y]))
            x, y, d = x[ok], y[ok], d[ok]
            most = (s[x] + s[y]) * ((1 - similarity) / (1 + similarity)) + 1e-6
            x, y = order[x], order[y]
            if root is not None:
                ok = root[x] != root[y]
                x, y, d, most = x[ok], y[ok], d[ok], most[ok]
            for at in range(0, len(x), PAIRS):
                q = slice(at, at + PAIRS)
                ok = np.bitwise_count(sketches[x[q]] ^ sketches[y[q]]).sum(axis=1, dtype=np.int64) <= most[q]
                if ok.any():
                    yield x[q][ok], y[q][ok], d[q][ok]


def thinned_edges(n: int, blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, bool]:
    """The edges of all blocks, dense ones thinned, and whether any were left out."""
    empty = np.empty(0, np.int64)
    parts, less = [(empty, empty, np.empty(0, np.uint8))], False
    for x, y, d in blocks:
        keep = thinned(n, x, y, d)
        less |= len(keep) < len(x)
        parts.append((x[keep], y[keep], d[keep]))
    x, y, d = (np.concatenate(v) for v in zip(*parts))
    keep = thinned(n, x, y, d)
    return x[keep], y[keep], less or len(keep) < len(x)


MASK = (1 << 64) - 1


def word_digest(text: bytes) -> int:
    """XXH64 of a text's words, A-Z lower-cased."""
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, radius: int = NEAR_RADIUS, key_col: str | None = None) -> DataFrame:
    """(id, group_id) of all rows: group_id is the smallest id among texts that are alike, the id itself for others.

    Texts are alike if the Jaccard similarity of their sets of word shingles reaches ``similarity``. Fingerprints
    of texts that have one of KEYS min-hash keys in common are compared in tiles (:func:`near_keys`), so a text meets those that may be alike, not all of
    its length. Pairs within ``radius`` bits, unless a bound by their parity sketches rules them out, are verified on the whole texts. Of a dense group, in which
    they outnumber the texts DENSE to one, FORESTS spanning forests are verified first, the closest pairs first, so a
    group of n near copies gives some n pairs, not n * n; then all other pairs of that group whose ends verified pairs have
    not connected. A group of more than HEAVY is first compared in parts of that size, dealt anew for each key; pairs of its parts follow only if it
    isn't connected by then.

    Texts equal in words are one node. A null id is no one's group: such rows keep a null group unless their text equals
    that of a row with an id. Null text counts as empty; texts without words are alike. Rows repeating an id count by each of
    their texts. An empty table gives an empty result. Other columns are not carried, but for
    ``key_col`` (a long that tells the texts of one id apart) if given; then ``first`` is whether the row has the smallest (id, key) of its group.
    """
    spark, none = df.sparkSession, np.empty(0, np.int64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, size, same, sketches, keys = [], [], [], [], []
            for t in b.column(1).to_pylist():
                h = np.unique(shingle_hashes(t, shingle))  # sets are compared, so each shingle counts once
                fp.append(simhash(h))
                size.append(len(h))
                sketches.append(parity_sketch(h))
                keys.append(near_keys(h) if len(h) else none)
                same.append(word_digest(t))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.array(same, np.uint64).view(np.int64)), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "row_key", "node", "fp", "size", "sketch", "keys"])

    plain = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"), (F.col(key_col).cast("long") if key_col else F.lit(0).cast("long")).alias("row_key"))
    rows = cut(plain.mapInArrow(sketch, "id long, row_key long, node long, fp long, size long, sketch binary, keys array<long>"))
    nodes = cut(rows.groupBy("node").agg(F.min("id").alias("id"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row_key"))).alias("least"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("sketch").alias("sketch"), F.min("keys").alias("keys")), small=True)
    classed = nodes.filter("size > 0 and id is not null")
    keyed = classed.select("node", F.explode("keys").alias("key")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    shared = cut(keyed.filter("n > 1").withColumn("m", F.ceil(F.col("n") / HEAVY).cast("int")).select("node", "key", "m"), small=True)
    attributes = classed.select(F.col("node").alias("named"), "fp", "size", "sketch")
    part = F.when(F.col("m") > 1, F.pmod(F.xxhash64("node", "key"), F.col("m"))).otherwise(0).cast("int")
    spots = lambda some: some.join(attributes, F.col("node") == F.col("named")).drop("named")
    dealt = spots(shared.withColumn("sub", part * F.lit((1 << 15) + 1)))

    def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        node, fp, size, key, sub, root = (t.column(c).to_numpy() for c in ("node", "fp", "size", "key", "sub", "root"))
        sketches = t.column("sketch")
        order = np.lexsort((sub, key))
        node, fp, size, key, sub, root = (v[order] for v in (node, fp.view(np.uint64), size, key, sub, root))
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
        for a, b in zip(starts, np.r_[starts[1:], len(node)]):
            sketch = folded(sketches.take(pa.array(order[a:b])).to_pylist())
            yield key[a], sub[a], node[a:b], root[a:b], (fp[a:b], size[a:b], np.zeros(b - a, bool), sketch, radius, similarity)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sub, node, _, given in groups_of(batches):
            x, y, less = thinned_edges(len(node), near_edges(*given))
            a, b, left = np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), np.zeros(len(x), bool)
            if less and not sub:  # a row that names the group; of those in parts all are looked at again
                a, b, left = np.r_[a, key], np.r_[b, sub], np.r_[left, True]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(left)], ["a", "b", "left"])

    def compare_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, node, root, given in groups_of(batches):
            if (root == root[0]).all():
                continue
            for x, y, _ in near_edges(*given, root=root):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], ["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for na, nb, ta, tb in zip(*(c.to_pylist() for c in b.columns)):
                if (word_digest(ta) - na) & MASK or (word_digest(tb) - nb) & MASK:  # another text of the same id
                    keep.append(False)
                    continue
                x, y = (np.unique(shingle_hashes(t, shingle)) for t in (ta, tb))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            b = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"])

    named = nodes.select(F.col("node").alias("n"), F.col("id").alias("i"))

    def verified(found: DataFrame) -> DataFrame:
        pairs = cut(found.join(named, F.col("a") == F.col("n")).select("a", "b", F.col("i").alias("ia")).join(named, F.col("b") == F.col("n")).select("a", "b", "ia", F.col("i").alias("ib")), small=True)
        texts = taking_part(df, pairs.select(F.col("ia").alias("id")).union(pairs.select("ib")), id_col, text_col)
        both = pairs.join(texts.select(F.col("id").alias("xa"), F.col("t").alias("ta")), F.col("ia") == F.col("xa")).join(texts.select(F.col("id").alias("xb"), F.col("t").alias("tb")), F.col("ib") == F.col("xb")).select("a", "b", "ta", "tb")
        return both.mapInArrow(verify, "a long, b long")

    n = shuffle_partitions(spark)
    found = cut(dealt.withColumn("root", F.col("node")).repartition(n, "key", "sub").mapInArrow(compare, "a long, b long, left boolean").distinct(), small=True)
    linked = connected_components(verified(found.filter("not left").select("a", "b")))
    thin = found.filter("left").select(F.col("a").alias("k")).union(shared.filter("m > 1").select("key")).distinct()
    if not thin.isEmpty():
        linked = cut(linked, small=True)
        few = F.broadcast if thin.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else (lambda x: x)
        rest = shared.join(few(thin), F.col("key") == F.col("k"), "left_semi").join(linked.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").drop("n").withColumn("root", F.coalesce("root", "node"))
        of_key = Window.partitionBy("key")
        rest = rest.withColumn("low", F.min("root").over(of_key)).withColumn("high", F.max("root").over(of_key)).filter("low <> high").drop("low", "high")
        pairs_of_parts = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.least(part, j) * F.lit(1 << 15) + F.greatest(part, j))
        rest = spots(rest.withColumn("sub", F.explode(pairs_of_parts)))
        more = rest.repartition(n, "key", "sub").mapInArrow(compare_rest, "a long, b long").distinct().join(found.filter("not left"), ["a", "b"], "left_anti")
        linked = connected_components(verified(more).union(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    linked = linked.withColumnRenamed("node", "n")
    labelled = nodes.join(linked, F.col("node") == F.col("n"), "left").select("node", "id", "least", F.coalesce("root", "node").alias("r"))
    groups = labelled.groupBy("r").agg(F.min("id").alias("group_id"), F.min("least").alias("lowest")).withColumnRenamed("r", "g")
    of = labelled.join(groups, F.col("r") == F.col("g")).select(F.col("node").alias("n"), "group_id", "lowest")
    return rows.join(of, F.col("node") == F.col("n")).select(F.col("id").alias(id_col), "group_id", *([F.col("row_key").alias(key_col), (F.struct("id", "row_key") == F.col("lowest")).alias("first")] if key_col else []))
