"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Below the worst piece by this much: the score of a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Chunks of at most so many bytes are decoded together by numpy, longer ones by themselves; chunks remembered in a task.
TOGETHER, REMEMBERED = 48, 150_000
CHUNK = re.compile(rb" +[^ ]*")


def _varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 127) << shift
        if x < 128:
            return out, at
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        if key & 7 == 0:
            value, at = _varint(b, at)
        elif key & 7 == 1:
            value, at = b[at : at + 8], at + 8
        elif key & 7 == 5:
            value, at = struct.unpack_from("<f", b, at)[0], at + 4
        else:
            size, at = _varint(b, at)
            value, at = b[at : at + size], at + size
        yield key >> 3, value


def read_model(path: str = MODEL) -> list[tuple[bytes, float, int]]:
    """(piece, score, kind) of a SentencePiece model file, in order of id."""
    with open(path, "rb") as f:
        raw = f.read()
    out = []
    for field, value in _fields(raw):
        if field == 1:
            p = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
            out.append((p[1], p[2], p[3]))
    return out


class Unigram:
    """Encoder and decoder of one vocabulary.

    Spaces are written as the marker U+2581 and one marker is put before the text. The pieces of
    a text are those with the largest sum of scores; of equal sums, the first found from the left, by
    shorter pieces at a place first. A character that no piece covers is written as its UTF-8 bytes' pieces.
    No piece has a marker after another character, so every run of markers starts a chunk whose
    pieces are found on their own; that gives the pieces of the whole text. Decoding
    joins the pieces, turns markers into spaces and drops the first one. Texts without U+2581 come back as they were.
    """

    def __init__(self, pieces: list[tuple[bytes, float, int]]):
        self.bytes_of = [p.replace(MARK, b" ") if kind not in (CONTROL, UNKNOWN) else b"" for p, _, kind in pieces]
        self.byte_id = np.zeros(256, np.int64)
        words = []
        for i, (p, score, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif kind in (NORMAL, USER):
                words.append((p.replace(MARK, b" "), i))
        if any(b" " in w.lstrip(b" ") for w, _ in words):
            raise ValueError("pieces with a marker inside are not supported")
        self.score = np.array([s for _, s, _ in pieces])
        self.unknown = min((self.score[i] for _, i in words if self.score[i] > -1e8), default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(w) for w, _ in words), default=1)
        self._build(sorted(words))

    def _build(self, words: list[tuple[bytes, int]]) -> None:
        """Double array: the child of state s by byte c is t = base[s] + c + 1 if check[t] == s; piece[t] is its id or -1."""
        size = 1 << 18
        base, check, piece = (np.full(size, x, np.int32) for x in (0, -1, -1))
        check[0] = 0
        todo: list = []  # nodes with the most children are placed first, single children fill the gaps

        def put(s: int, lo: int, hi: int, depth: int) -> None:
            if len(words[lo][0]) == depth:
                piece[s] = words[lo][1]
                lo += 1
            kids, at = [], lo
            while at < hi:
                c, start = words[at][0][depth], at
                while at < hi and words[at][0][depth] == c:
                    at += 1
                kids.append((c, start, at))
            if kids:
                heapq.heappush(todo, (-len(kids), s, kids, depth + 1))

        if words:
            put(0, 0, len(words), 0)
        low = 1
        while todo:
            _, s, kids, depth = heapq.heappop(todo)
            codes = np.array([c for c, _, _ in kids]) + 1
            b, look = 0, 256
            while check[low] >= 0:
                low += 1
            at = low
            while not b:
                if at + look + 600 > len(check):
                    base, check, piece = (np.append(x, np.full(len(x), y, np.int32)) for x, y in ((base, 0), (check, -1), (piece, -1)))
                free = np.nonzero(check[at : at + look] < 0)[0] + at - codes[0]
                free = free[free >= 1]
                fits = free[(check[free[:, None] + codes] < 0).all(axis=1)] if len(free) else free
                b, at, look = (int(fits[0]) if len(fits) else 0), at + look, min(look * 2, 1 << 14)
            base[s] = b
            places = (b + codes).tolist()
            check[places] = s
            for (_, start, end), t in zip(kids, places):
                put(t, start, end, depth)
        end = int(np.nonzero(check >= 0)[0].max()) + 260
        self.base, self.check, self.piece = (np.append(x, np.full(max(0, end - len(x)), y, np.int32))[:end] for x, y in ((base, 0), (check, -1), (piece, -1)))
        self.lists = None

    def encode_chunk(self, chunk: bytes) -> list[int]:
        """Viterbi over one chunk, in plain Python; the state carried is the best sum at each byte."""
        if self.lists is None:
            self.lists = self.base.tolist(), self.check.tolist(), self.piece.tolist(), self.score.tolist()
        base, check, piece, score = self.lists
        n = len(chunk)
        best, came, by = [-1e300] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            char = at + (1 if chunk[at] < 0xC0 else 2 if chunk[at] < 0xE0 else 3 if chunk[at] < 0xF0 else 4)
            here, state, k, covered = best[at], 0, at, False
            while k < n:
                t = base[state] + chunk[k] + 1
                if check[t] != state or not base[state]:
                    break
                state, k = t, k + 1
                p = piece[t]
                if p >= 0:
                    covered |= k == char
                    if here + score[p] > best[k]:
                        best[k], came[k], by[k] = here + score[p], at, p
            if not covered and here + self.unknown > best[min(char, n)]:
                best[min(char, n)], came[min(char, n)], by[min(char, n)] = here + self.unknown, at, -1
            at = min(char, n)
        out, k = [], n
        while k:
            out += [by[k]] if by[k] >= 0 else self.byte_id[list(chunk[came[k] : k])][::-1].tolist()
            k = came[k]
        return out[::-1]

    def encode_chunks(self, chunks: list[bytes]) -> list[np.ndarray]:
        """The same for many chunks: all of a length class step through the trie together."""
        out: list = [None] * len(chunks)
        sizes = np.array([len(c) for c in chunks])
        for low, high in ((0, 6), (6, 10), (10, 16), (16, 28), (28, TOGETHER)):
            which = np.nonzero((sizes > low) & (sizes <= high))[0]
            for part in np.array_split(which, max(1, -(-len(which) // 20000))) if len(which) else ():
                for i, ids in zip(part.tolist(), self._together([chunks[i] for i in part.tolist()], sizes[part], high)):
                    out[i] = ids
        for i in np.nonzero(sizes > TOGETHER)[0].tolist():
            out[i] = np.array(self.encode_chunk(chunks[i]), np.int32)
        return out

    def _together(self, chunks: list[bytes], sizes: np.ndarray, width: int) -> list[np.ndarray]:
        n = len(chunks)
        text = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in chunks), np.uint8).reshape(n, width).astype(np.int32)
        best, came, by = np.full((n, width + 1), -1e300), np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        best[:, 0] = 0.0
        for at in range(width):
            rows = np.nonzero((best[:, at] > -1e299) & (sizes > at))[0]
            if not len(rows):
                continue
            lead = text[rows, at]
            char = np.minimum(at + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), sizes[rows])
            covered, alive, state = np.zeros(len(rows), bool), np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for k in range(at, min(width, at + self.longest)):
                inside = sizes[rows[alive]] > k
                alive, state = alive[inside], state[inside]
                t = self.base[state] + text[rows[alive], k] + 1
                go = (self.check[t] == state) & (self.base[state] > 0)
                alive, state = alive[go], t[go]
                if not len(alive):
                    break
                p = self.piece[state]
                hit = p >= 0
                who, p = alive[hit], p[hit]
                covered[who] |= char[who] == k + 1
                r = rows[who]
                new = best[r, at] + self.score[p]
                better = new > best[r, k + 1]
                r = r[better]
                best[r, k + 1], came[r, k + 1], by[r, k + 1] = new[better], at, p[better]
            r, c = rows[~covered], char[~covered]
            new = best[r, at] + self.unknown
            better = new > best[r, c]
            r, c = r[better], c[better]
            best[r, c], came[r, c], by[r, c] = new[better], at, -1
        # walk back, all rows together; an uncovered character gives its bytes one by one
        ids, k, rows, used = np.zeros((n, width), np.int32), sizes.copy(), np.arange(n), np.zeros(n, np.int64)
        while len(rows):
            b, c = by[rows, k[rows]], came[rows, k[rows]]
            raw = b < 0
            last = text[rows, k[rows] - 1]
            ids[rows, used[rows]] = np.where(raw, self.byte_id[last], b)
            used[rows] += 1
            # inside a raw character step one byte, and keep the state "raw" for its earlier bytes
            step = np.where(raw, k[rows] - 1, c)
            more = raw & (step > c)
            by[rows[more], step[more]], came[rows[more], step[more]] = -1, c[more]
            k[rows] = step
            rows = rows[step > 0]
        flat = ids[:, ::-1]
        return [flat[i, width - u :] for i, u in enumerate(used.tolist())]

    def encode_batch(self, texts: list[bytes], memory: dict[bytes, bytes] | None = None) -> list[np.ndarray]:
        """Ids of each text. Each chunk that texts share is decoded once and remembered as the bytes of its ids."""
        memory = {} if memory is None else memory
        if len(memory) > REMEMBERED:
            memory.clear()
        split = [CHUNK.findall(b" " + t.replace(MARK, b" ")) if t else [] for t in texts]
        new = list({c for s in split for c in s if c not in memory})
        memory.update(zip(new, (x.astype(np.int32).tobytes() for x in self.encode_chunks(new))))
        return [np.frombuffer(b"".join([memory[c] for c in s]), np.int32) for s in split]

    def decode(self, ids) -> bytes:
        table = self.bytes_of
        joined = b"".join([table[i] for i in (ids.tolist() if hasattr(ids, "tolist") else ids)])
        return joined[1:] if joined[:1] == b" " else joined


@lru_cache(maxsize=4)
def vocabulary(path: str = MODEL) -> Unigram:
    return Unigram(read_model(path))


def _tokens(df: DataFrame, text_col: str, model: str):
    """The vocabulary as a broadcast variable, whose size the vocabulary bounds."""
    return df.sparkSession.sparkContext.broadcast(vocabulary(model))


def encode(df: DataFrame, text_col: str = "text", out_col: str = "token_ids", model: str = MODEL, check_col: str | None = None) -> DataFrame:
    """The input with ``out_col`` added (replaced if there): array of int ids; null text gives null, empty text an empty array.

    ``check_col`` adds whether decoding the ids gives the text again (null for null).

    Ids, ties, repeated rows and other columns pass through as they are. The model file is read on the driver only.
    """
    from pyspark.sql import types as T

    kept = [c for c in df.columns if c not in (out_col, check_col)]
    shared, names = _tokens(df, text_col, model), [*kept, out_col, *([check_col] if check_col else [])]
    plain = df.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for b in batches:
            for low in range(0, b.num_rows, 512):
                part = b.slice(low, 512)
                texts = [None if t is None else t.encode() for t in part.column(at).to_pylist()]
                ids = shared.value.encode_batch([t or b"" for t in texts], memory)
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                mask = pa.array([t is None for t in texts])
                arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()), mask=mask)
                checks = [pa.array([None if t is None else shared.value.decode(x) == t for x, t in zip(ids, texts)], pa.bool_())] if check_col else []
                yield pa.RecordBatch.from_arrays([*part.columns, arrays, *checks], names)

    added = [T.StructField(out_col, T.ArrayType(T.IntegerType())), *([T.StructField(check_col, T.BooleanType())] if check_col else [])]
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *added]))


def decode(df: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """The input with ``out_col`` added: the text of the ids; null ids give null; bytes that are no UTF-8 become U+FFFD."""
    from pyspark.sql import types as T

    kept = [c for c in df.columns if c != out_col]
    shared, names = _tokens(df, ids_col, model), [*kept, out_col]
    plain = df.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else shared.value.decode(x).decode("utf-8", "replace") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names)

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(out_col, T.StringType())]))


def token_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per input row: id, n_tokens, n_byte_tokens, ids_sha256 (of the ids as little-endian int32), round_trip.

    Each text is encoded, its ids are decoded again and compared with the text. Null text counts as empty: no tokens, true.
    """
    shared = _tokens(df, text_col, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        v = shared.value
        is_byte = np.zeros(len(v.bytes_of), bool)
        is_byte[v.byte_id] = True
        for b in batches:
            for low in range(0, b.num_rows, 512):
                part = b.slice(low, 512)
                texts = [t or b"" for t in part.column(1).to_pylist()]
                ids = v.encode_batch(texts, memory)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]), pa.array([v.decode(x) == t for x, t in zip(ids, texts)])], [id_col, "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"])

    plain = df.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("__t"))
    return plain.mapInArrow(run, f"`{id_col}` {plain.dtypes[0][1]}, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean")
