"""Cross-tokenizer alignment: an event sweep over the ends of the tokens of two tokenizers.

Tokens end at byte offsets. The ends of both tokenizers are put into one stream for each document, dealt by document and sorted by
offset; where both end, a group closes. Events travel in blocks: a block holds up to BLOCK consecutive tokens of one side and the
offset at which they begin, and the tokens' lengths give their ends. One row an event would be ten times the bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import release, shuffle_partitions, stored
from corvane.llm.unigram import MARK, _fields
from corvane.sources.tables import spread_rows

FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Tokens in a block of events, links made at a time, and id pairs that are broadcast at most (some 70 MB).
BLOCK, TOGETHER, PAIRS = 4096, 1 << 20, 1 << 22
#: Chunks of text remembered in a task, and the longest of them.
REMEMBERED, LONGEST = 150_000, 64
#: Model files larger than this are refused: they are sent to all executors.
LARGEST_FILE = 64 << 20
#: How the times of pairs are packed, by the first byte.
WIDTHS = {b"2": "<u2", b"8": "<i8"}
# How byte-level BPE cuts texts before merging, as in the public encoders of that kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed values end.


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Side A: byte-level BPE from a tokenizer file. Ids are those of the file's tokenizer, special tokens being plain text."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", ())}
        self.bytes_of: list[bytes] = [b""] * (max(vocab.values(), default=0) + 1)
        ranks = {}
        for piece, i in vocab.items():
            if piece not in special:
                self.bytes_of[i] = bytes(letters[c] for c in piece)
                ranks[self.bytes_of[i]] = i
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # merges whose results are numbered in their order are what the faster encoder takes
        in_order = [vocab.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges)))
        first = spec.get("pre_tokenizer") or {}
        if in_order and spec.get("normalizer") is None and first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True):
            import tiktoken

            own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            # without a normaliser the tokens' bytes are the text's, whatever it is
            self.spells, self.encode = True, lambda text: own.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_str(raw.decode())
            whole.encode_special_tokens = True
            self.spells, self.encode = False, lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """Side B: a SentencePiece model. Texts are cut before runs of spaces and each cut is encoded once, if no piece of the model reaches over such a cut."""

    CHUNK = re.compile(r" +[^ ]*")

    def __init__(self, raw: bytes):
        import sentencepiece

        self.own, self.memory = sentencepiece.SentencePieceProcessor(model_proto=raw), {}
        ids = range(self.own.get_piece_size())
        pieces = [self.own.id_to_piece(i).encode() for i in ids]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace(MARK, b" ") for i, p in zip(ids, pieces)]
        spec = {k: dict(_fields(v)) for k, v in _fields(raw) if k in (2, 3)}
        trainer, normal = spec.get(2, {}), spec.get(3, {})
        as_written = not normal.get(2) and normal.get(3, 1) and not normal.get(4, 1) and normal.get(5, 1)
        self.lone = self.own.piece_to_id(MARK.decode())  # a space that nothing follows: without it, the encoder sees no text to put it before
        self.cuts = bool(as_written and not self.own.is_unknown(self.lone) and trainer.get(3) == 2 and not trainer.get(24) and not any(MARK in p.lstrip(MARK) for p in pieces))

    def encode_all(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of space + text; None if the pieces don't spell it."""
        if not self.cuts:
            ids = [np.array(x, np.int64) for x in self.own.encode(texts, num_threads=1)] if texts else []
            return [x if b"".join([self.bytes_of[i] for i in x.tolist()]) == b" " + t.encode() else None for x, t in zip(ids, texts)]
        split = [self.CHUNK.findall(" " + t) for t in texts]
        new = list({c for s in split for c in s if c not in self.memory})
        if new:
            for c, ids in zip(new, self.own.encode([c[1:] for c in new], num_threads=1)):
                ids = [self.lone] if c == " " else ids
                spelt = b"".join([self.bytes_of[i] for i in ids]) == c.encode()
                self.memory[c] = np.array(ids, "<i4").tobytes() if spelt else None
        out = []
        for s in split:
            try:
                out.append(np.frombuffer(b"".join([self.memory[c] for c in s]), "<i4").astype(np.int64))
            except TypeError:  # a cut that isn't spelt
                out.append(None)
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        for c in new:
            if len(c) > LONGEST:
                self.memory.pop(c, None)
        return out


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(LARGEST_FILE + 1)
    if len(raw) > LARGEST_FILE:
        raise ValueError(f"{path} is larger than {LARGEST_FILE} bytes")
    return raw


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


class Sides:
    """The two vocabularies: bytes of the tokens and how ids are packed. Their size bounds what is sent to executors."""

    def __init__(self, raw_a: bytes, raw_b: bytes):
        self.raw = raw_a, raw_b
        both = ByteLevel(raw_a).bytes_of, Pieces(raw_b).bytes_of
        self.lengths = [np.array([len(x) for x in side], np.int64) for side in both]
        self.sizes = [len(side) for side in both]
        self.types = [id_type(n) for n in self.sizes]
        self.key_type = "<u4" if self.sizes[0] * self.sizes[1] < 1 << 32 else "<u8"

    def encoders(self) -> tuple[ByteLevel, Pieces]:
        return ByteLevel(self.raw[0]), Pieces(self.raw[1])


def sides(folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B) -> Sides:
    return Sides(_read(f"{folder}/{file_a}"), _read(f"{folder}/{file_b}"))


def token_events(df: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """(row, id, at, side, n, ids): blocks of the tokens' events; a row without tokens has one empty block.

    ``row`` numbers the input's rows before anything is dealt, so that lost tasks that run again give the same numbers.
    """
    kind = df.select(id_col).dtypes[0][1]
    rows = spread_rows(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        a, b = v.encoders()
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                texts = part.column(2).to_pylist()
                out: list[tuple] = []
                for i, (text, ids_b) in enumerate(zip(texts, b.encode_all(texts))):
                    ids_a = a.encode(" " + text) if text and ids_b is not None else None
                    if ids_a is None or not a.spells and b"".join([a.bytes_of[x] for x in ids_a.tolist()]) != b" " + text.encode():
                        out.append((i, 0, 0, 0, b""))
                        continue
                    for side, ids in enumerate((ids_a, ids_b)):
                        ends = np.cumsum(v.lengths[side][ids])
                        for k in range(0, len(ids), BLOCK):
                            block = ids[k : k + BLOCK]
                            out.append((i, int(ends[k - 1]) if k else 0, side, len(block), codec.compress(block.astype(v.types[side]).tobytes(), asbytes=True)))
                at = pa.array([x[0] for x in out], pa.int64())
                columns = [part.column(0).take(at), part.column(1).take(at), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.int32()), pa.array([x[4] for x in out], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "at", "side", "n", "ids"])

    return rows.mapInArrow(run, f"row long, id {kind}, at long, side int, n int, ids binary")


def added(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(times, starts)


def linked(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, size_b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, times) of the links of consecutive groups with na and nb tokens, key = a * size_b + b; at most about TOGETHER at a time.

    A group of more links than that gives its distinct pairs, weighted by how often their ids stand in it."""
    start_a, start_b, links = np.cumsum(na) - na, np.cumsum(nb) - nb, na * nb
    large = links > TOGETHER
    for g in np.flatnonzero(large):
        ua, ca = np.unique(a[start_a[g] : start_a[g] + na[g]], return_counts=True)
        ub, cb = np.unique(b[start_b[g] : start_b[g] + nb[g]], return_counts=True)
        step = max(1, TOGETHER // len(ub))
        for k in range(0, len(ua), step):
            yield (ua[k : k + step, None] * size_b + ub).ravel(), (ca[k : k + step, None] * cb).ravel()
    small = np.flatnonzero(~large)
    parts = np.cumsum(links[small]) // TOGETHER
    for which in np.split(small, np.flatnonzero(np.diff(parts)) + 1) if len(small) else ():
        n = links[which]
        owner = np.repeat(np.arange(len(which)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        width = nb[which][owner]
        keys = a[start_a[which][owner] + place // width] * size_b + b[start_b[which][owner] + place % width]
        yield keys, np.ones(len(keys), np.int64)


class Sweep:
    """What the sweep holds of one document: tokens since the last closed group, counts, the running hash, and the distinct id pairs with their times."""

    def __init__(self, v: Sides, words: list[bytes], row: int, who):
        self.v, self.words, self.row, self.who = v, words, row, who
        self.ids, self.ends = [np.empty(0, np.int64)] * 2, [np.empty(0, np.int64)] * 2
        self.n, self.groups, self.links, self.hash, self.between = [0, 0], 0, 0, hashlib.sha256(), b""
        self.keys, self.times, self.waiting, self.size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def add(self, side: int, at: int, ids: np.ndarray) -> tuple | None:
        """A block of events; gives (ids, ends, group of each token) of the groups it closes."""
        self.ids[side] = np.concatenate([self.ids[side], ids])
        self.ends[side] = np.concatenate([self.ends[side], at + np.cumsum(self.v.lengths[side][ids])])
        self.n[side] += len(ids)
        ea, eb = self.ends
        if not len(ea) or not len(eb):
            return None
        common = ea[eb[np.minimum(np.searchsorted(eb, ea), len(eb) - 1)] == ea]
        if not len(common):
            return None
        cut = [np.searchsorted(e, common[-1], "right") for e in self.ends]
        ids, ends = [x[:k] for x, k in zip(self.ids, cut)], [x[:k] for x, k in zip(self.ends, cut)]
        self.ids, self.ends = [x[k:] for x, k in zip(self.ids, cut)], [x[k:] for x, k in zip(self.ends, cut)]
        return ids, ends, [np.searchsorted(common, e) for e in ends]

    def take(self, ids, ends, groups) -> None:
        """Count the closed groups, their links and pairs, and hash their text."""
        g = int(groups[0][-1]) + 1
        na, nb = np.bincount(groups[0], minlength=g), np.bincount(groups[1], minlength=g)
        self.groups += g
        self.links += int((na * nb).sum())
        last = [np.r_[x[1:] != x[:-1], True] for x in groups]
        codes = np.concatenate([ids[0] * 2 + last[0], 2 * self.v.sizes[0] + ids[1] * 2 + last[1]])
        order = np.argsort(np.concatenate([groups[0] * 2, groups[1] * 2 + 1]), kind="stable")
        text = b"".join([self.words[c] for c in codes[order].tolist()])
        self.hash.update(self.between + text[:-1])
        self.between = b";"
        for keys, times in linked(ids[0], ids[1], na, nb, self.v.sizes[1]):
            self.waiting.append((keys, times))
            self.size += len(keys)
            if self.size > 2 * TOGETHER:
                self.settle()

    def settle(self) -> None:
        keys, times = zip((self.keys, self.times), *self.waiting)
        self.keys, self.times = added(np.concatenate(keys), np.concatenate(times))
        self.waiting, self.size = [], 0


def words_of(v: Sides) -> list[bytes]:
    """Ids as they stand in the text of groups, each with the sign that follows it inside its group and at its end."""
    return [b"%d%s" % (i, sign) for side, signs in enumerate(((b",", b"|"), (b",", b";"))) for i in range(v.sizes[side]) for sign in signs]


def _swept(batches: Iterator[pa.RecordBatch], v: Sides, words: list[bytes]) -> Iterator[tuple[Sweep, tuple | None, bool]]:
    """(state, closed groups or None, whether the document ends) in the order of the events."""
    codec, state = pa.Codec("zstd"), None
    for b in batches:
        who = b.column(1).to_pylist()
        for i, (row, at, side, n, packed) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4, 5)))):
            if state is not None and state.row != row:
                yield state, None, True
                state = None
            state = state or Sweep(v, words, row, who[i])
            if n:
                ids = np.frombuffer(codec.decompress(packed, n * np.dtype(v.types[side]).itemsize, asbytes=True), v.types[side]).astype(np.int64)
                closed = state.add(side, at, ids)
                if closed:
                    yield state, closed, False
    if state is not None:
        yield state, None, True


def _in_order(events: DataFrame) -> DataFrame:
    return events.repartition(shuffle_partitions(events.sparkSession), "row").sortWithinPartitions("row", "at", "side")


def _renamed(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumnRenamed("id", id_col)


def alignment_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Sides | None = None) -> DataFrame:
    """(row, id, start, end, a_ids, b_ids): the groups, by byte offsets in space + text; texts without tokens have none.

    ``row`` tells rows that repeat an id apart. Links are the pairs of a_ids and b_ids of a group.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or sides())
    events = token_events(df, shared, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: dict = {}
        for state, closed, ends_here in _swept(batches, shared.value, []):
            if closed:
                ids, ends, groups = closed
                stops = ends[0][np.r_[groups[0][1:] != groups[0][:-1], True]]
                starts, n = np.r_[begun.pop(state.row, 0), stops[:-1]], len(stops)
                begun[state.row] = int(stops[-1])
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(g, minlength=n))], pa.int32()), pa.array(x, pa.int32())) for x, g in zip(ids, groups)]
                yield pa.RecordBatch.from_arrays([pa.array([state.row] * n, pa.int64()), pa.array([state.who] * n, kind), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), *lists], ["row", "id", "start", "end", "a_ids", "b_ids"])
            if ends_here:
                begun.pop(state.row, None)

    spark_kind = dict(events.dtypes)["id"]
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(events.schema["id"].dataType)
    return _renamed(_in_order(events).mapInArrow(run, f"row long, id {spark_kind}, start long, `end` long, a_ids array<int>, b_ids array<int>"), id_col)


def swept_documents(df: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, n_pairs, keys, times): one row a document; keys and times are its distinct id pairs, packed."""
    events = token_events(df, shared, id_col, text_col)
    from pyspark.sql.pandas.types import to_arrow_type

    kind, names = to_arrow_type(events.schema["id"].dataType), ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "keys", "times"]
    types = [pa.int64(), kind, *[pa.int64()] * 4, pa.string(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, codec, out = shared.value, pa.Codec("zstd", compression_level=3), []
        words = words_of(v)
        for state, closed, ends_here in _swept(batches, v, words):
            if closed:
                state.take(*closed)
            if ends_here:
                state.settle()
                some = state.groups > 0
                keys = np.diff(state.keys, prepend=0).astype(v.key_type)
                width = b"8" if some and state.times.max() > 65535 else b"2"
                packed = codec.compress(keys.tobytes(), asbytes=True), width + codec.compress(state.times.astype(WIDTHS[width]).tobytes(), asbytes=True)
                out.append((state.row, state.who, *state.n, state.groups, state.links, state.hash.hexdigest() if some else "", len(keys), *(packed if some else (b"", b""))))
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    return _in_order(events).mapInArrow(run, f"row long, id {dict(events.dtypes)['id']}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, keys binary, times binary")


def unpacked(codec: pa.Codec, v: Sides, n: int, keys: bytes, times: bytes | None) -> tuple[np.ndarray, np.ndarray | None]:
    k = np.cumsum(np.frombuffer(codec.decompress(keys, n * np.dtype(v.key_type).itemsize, asbytes=True), v.key_type).astype(np.int64))
    if times is None:
        return k, None
    kind = WIDTHS[times[:1]]
    return k, np.frombuffer(codec.decompress(times[1:], n * int(kind[2]), asbytes=True), kind).astype(np.int64)


def pair_counts(swept: DataFrame, shared) -> DataFrame:
    """(key, n): in how many documents each id pair is linked; counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, codec = shared.value, pa.Codec("zstd")
        keys, times, waiting, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def settled():
            k = np.concatenate([keys, *waiting])
            return added(k, np.concatenate([times, np.ones(len(k) - len(keys), np.int64)]))

        for b in batches:
            for n, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                waiting.append(unpacked(codec, v, n, packed, None)[0])
                size += n
                if size > 2 * TOGETHER:
                    keys, times = settled()
                    waiting, size = [], 0
                    if len(keys) > TOGETHER:  # what a task holds stays bounded
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["key", "n"])
                        keys, times = keys[:0], times[:0]
        keys, times = settled()
        for low in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[low : low + (1 << 16)]), pa.array(times[low : low + (1 << 16)])], ["key", "n"])

    return swept.filter("n_pairs > 0").select("n_pairs", "keys").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _looked_up(k: np.ndarray, times: np.ndarray, keys: np.ndarray, n: np.ndarray, top: np.ndarray) -> tuple[int, int]:
    at = np.searchsorted(keys, k)
    return int(times[top[at]].sum()), int((times * n[at]).sum())


def _by_broadcast(swept: DataFrame, counts: DataFrame, shared) -> DataFrame:
    """n_best and count_sum by a table of all pairs' counts, whose size was checked."""
    got = counts.toArrow()
    keys, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    a = keys // shared.value.sizes[1]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    best = np.repeat(np.maximum.reduceat(n, starts), np.diff(np.r_[starts, len(a)])) if len(a) else n
    known = swept.sparkSession.sparkContext.broadcast((keys, n, n == best))
    plain = [c for c in swept.columns if c not in ("n_pairs", "keys", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, codec = shared.value, pa.Codec("zstd")
        for b in batches:
            found = [_looked_up(*unpacked(codec, v, m, k, t), *known.value) if m else (0, 0) for m, k, t in zip(*(b.column(c).to_pylist() for c in ("n_pairs", "keys", "times")))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in plain], pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], [*plain, "n_best", "count_sum"])

    types = dict(swept.dtypes)
    return swept.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in plain) + ", n_best long, count_sum long")


def _by_buckets(swept: DataFrame, counts: DataFrame, shared, n_counts: int, most: int) -> DataFrame:
    """The same for any number of pairs: counts and documents' pairs are dealt into buckets of A ids, a bucket's counts being sent to several tasks among which documents are dealt."""
    spark, size_b = swept.sparkSession, shared.value.sizes[1]
    buckets = 2 * -(-n_counts // most)
    salts = max(1, -(-shuffle_partitions(spark) // buckets))
    a = F.floor(F.col("key") / size_b).cast("long")
    rows = counts.withColumn("a", a)
    best = rows.groupBy("a").agg(F.max("n").alias("best")).withColumnRenamed("a", "best_a")
    marked = rows.join(best, F.col("a") == F.col("best_a")).select(F.pmod("a", F.lit(buckets)).cast("int").alias("bucket"), "key", "n", (F.col("n") == F.col("best")).alias("top"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, key, n, top = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            which = [np.flatnonzero(bucket == x) for x in np.unique(bucket)]
            yield pa.RecordBatch.from_arrays([pa.array([bucket[w[0]] for w in which], pa.int32()), pa.array([-1] * len(which), pa.int64()), pa.array([key[w].astype("<i8").tobytes() for w in which], pa.binary()), pa.array([(n[w] * 2 + top[w]).astype("<i8").tobytes() for w in which], pa.binary())], ["bucket", "row", "keys", "times"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, codec = shared.value, pa.Codec("zstd")
        for b in batches:
            out = []
            for row, m, k, t in zip(*(c.to_pylist() for c in b.columns)):
                keys, times = unpacked(codec, v, m, k, t)
                at = keys // size_b % buckets
                order = np.argsort(at, kind="stable")
                for w in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    out.append((int(at[w[0]]), row, keys[w].astype("<i8").tobytes(), times[w].astype("<i8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "row", "keys", "times"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, table = None, [], None
        for b in batches:
            rows, best, total = [], [], []
            for bucket, salt, row, k, t in zip(*(b.column(c).to_pylist() for c in ("bucket", "salt", "row", "keys", "times"))):
                if (bucket, salt) != now:
                    now, parts, table = (bucket, salt), [], None
                k, t = np.frombuffer(k, "<i8"), np.frombuffer(t, "<i8")
                if row < 0:
                    parts.append((k, t))
                    continue
                if table is None:
                    keys, values = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(keys)
                    table = keys[order], values[order] >> 1, (values[order] & 1) == 1
                x, y = _looked_up(k, t, *table)
                rows.append(row), best.append(x), total.append(y)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(best, pa.int64()), pa.array(total, pa.int64())], ["row", "n_best", "count_sum"])

    packed = marked.repartition(buckets, "bucket").mapInArrow(pack, "bucket int, row long, keys binary, times binary").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = swept.filter("n_pairs > 0").select("row", "n_pairs", "keys", "times").mapInArrow(split, "bucket int, row long, keys binary, times binary").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    found = packed.unionByName(dealt).repartition(shuffle_partitions(spark), "bucket", "salt").sortWithinPartitions("bucket", "salt", "row").mapInArrow(look, "row long, n_best long, count_sum long")
    sums = found.groupBy(F.col("row").alias("found_row")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return swept.drop("n_pairs", "keys", "times").join(sums, F.col("row") == F.col("found_row"), "left").drop("found_row").na.fill(0, ["n_best", "count_sum"])


def alignment_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Sides | None = None, pairs: int = PAIRS) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts that the pieces of either side don't spell (a text with U+2581, say), have no tokens: zeros, an empty
    hash. Every row counts as a document, rows that repeat an id or a text too. Null ids stay; other columns go. A task holds the
    open group, two blocks of events and the distinct id pairs of one document. Up to ``pairs`` distinct id pairs corpus-wide,
    counted first, are broadcast with their counts; more are met in buckets.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model or sides())
    swept = stored(swept_documents(df, shared, id_col, text_col))
    release(spark)  # the events' shuffle files
    counts = stored(pair_counts(swept, shared))
    n = counts.count()
    out = _by_broadcast(swept, counts, shared) if n <= pairs else _by_buckets(swept, counts, shared, n, pairs)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
