"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents that the model is fitted on at most: those with the smallest hash of their id.
SAMPLE = 6000
THRESHOLD, FOLDS = 0.3, 5
RIDGE, STEPS = 1.0, 120

_CLASSES = np.zeros((7, 256), bool)
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:'\"-()", b"!?", b"#$%&*+/<=>@[\\]^_`{}~", b"|")):
    _CLASSES[_k, list(_set)] = True
NAMES = ("bias", "log bytes", "upper case", "digits", "spaces", "punctuation", "exclamation", "symbols", "bars", "high bytes", "word length", "word as before", "distinct words", "words ending in symbols", "log words", "line seen before", "empty", "short", "ends a sentence", "starts a sentence")


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, lines): a row for each line of each text, its length, and each text's number of lines (1 at least)."""
    buf = b"\n".join(texts) + b"\n"
    a = np.frombuffer(buf, np.uint8)
    per_text = np.array([t.count(b"\n") + 1 for t in texts])
    ends = np.flatnonzero(a == 10)
    starts = np.r_[0, ends[:-1] + 1]
    size = ends - starts
    n = len(starts)
    length = np.maximum(size, 1).astype(float)
    counts = [np.add.reduceat(_CLASSES[k][a], starts, dtype=np.int64) / length for k in range(len(_CLASSES))]
    high = np.add.reduceat(a >= 128, starts, dtype=np.int64) / length
    # words: first and last eight bytes and the length stand for a word
    word = ~(_CLASSES[2][a] | (a == 10))
    edge = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
    ws, we = edge[::2], edge[1::2]
    padded = buf + b"\0" * 8
    eight = np.ndarray((len(buf),), "<u8", padded, 0, (1,))
    wl = we - ws
    keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)[np.minimum(wl, 8)]
    h = ((eight[ws] & keep) * np.uint64(0x9E3779B97F4A7C15)) ^ ((eight[np.maximum(we - 8, ws)] & keep) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (wl.astype(np.uint64) << np.uint64(32))
    h ^= h >> np.uint64(29)
    line = np.searchsorted(ends, ws)
    words = np.bincount(line, minlength=n)
    many = np.maximum(words, 1)
    mean = np.bincount(line, wl, minlength=n) / many
    same = np.r_[False, (h[1:] == h[:-1]) & (line[1:] == line[:-1])]
    same = np.bincount(line[same], minlength=n) / many
    order = np.lexsort((h, line))
    hs, ls = h[order], line[order]
    fresh = np.r_[True, (hs[1:] != hs[:-1]) | (ls[1:] != ls[:-1])][: len(hs)]
    distinct = np.bincount(ls[fresh], minlength=n) / many
    symbol = (_CLASSES[4] | _CLASSES[5] | _CLASSES[6])[a[we - 1]] if len(we) else np.empty(0, bool)
    symbol = np.bincount(line[symbol], minlength=n) / many
    # a line seen before in its text
    first = np.cumsum(words) - words
    mixed = h * (((np.arange(len(h)) - first[line]).astype(np.uint64) << np.uint64(1)) | np.uint64(1))
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, line, mixed)
    text = np.repeat(np.arange(len(texts)), per_text)
    order = np.lexsort((np.arange(n), whole, text))
    again = np.zeros(n, bool)
    if n > 1:
        again[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (text[order[1:]] == text[order[:-1]]) & (words[order[1:]] > 0)
    last, head = a[np.maximum(ends - 1, starts)], a[starts]
    x = np.stack([
        np.ones(n), np.log1p(size), *counts, high, np.minimum(mean / 10, 5), same, distinct, symbol, np.log1p(words), again, words == 0, words <= 3,
        np.isin(last, list(b".!?:;")) & (size > 0), ((head >= 65) & (head <= 90)) | (head >= 128),
    ], axis=1).astype(np.float64)
    return x, size, per_text


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and after it; zeros at the ends of a text."""
    ends = np.cumsum(lines)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[ends - lines], after[ends - 1] = 0, 0
    return np.hstack([x, before, after])


def forward_backward(u: np.ndarray, lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """P(line is good), log partition and expected transitions of chains laid end to end.

    u is each line's log-odds of good over bad, trans the 2 x 2 transition scores. All chains
    step together, the longest first, so memory is that of the lines themselves.
    """
    order = np.argsort(-lines, kind="stable")
    size = lines[order]
    start = (np.cumsum(lines) - lines)[order]
    most = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(most), side="left")  # chains longer than t
    e = np.exp(trans)
    top = np.maximum(u, 0)
    pot = np.stack([np.exp(-top), np.exp(u - top)], axis=1)
    alpha, beta, scale = np.empty((len(u), 2)), np.ones((len(u), 2)), np.empty(len(u))
    for t in range(most):
        at = start[: active[t]] + t
        v = pot[at] if t == 0 else (alpha[at - 1] @ e) * pot[at]
        scale[at] = v.sum(axis=1)
        alpha[at] = v / scale[at][:, None]
    expected = np.zeros((2, 2))
    for t in range(most - 2, -1, -1):
        at = start[: active[t + 1]] + t
        v = pot[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = v @ e.T
        expected += e * (alpha[at].T @ v)
    good = alpha * beta
    return good[:, 1] / good.sum(axis=1), float(np.log(scale).sum() + top.sum()), expected


def fit(x: np.ndarray, lines: np.ndarray, label: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> dict:
    """Maximum likelihood with an L2 prior, by L-BFGS; every line of a training text carries its text's label."""
    mean, dev = x.mean(axis=0), x.std(axis=0)
    dev[dev < 1e-9] = 1.0
    mean[0], dev[0] = 0.0, 1.0  # the bias stays as it is
    z = with_neighbours((x - mean) / dev, lines)
    y = np.repeat(label, lines).astype(float)
    inner = np.repeat(label, np.maximum(lines - 1, 0)).astype(int)
    seen = np.diag(np.bincount(inner, minlength=2).astype(float))
    d = z.shape[1]
    scale = 1.0 / max(len(label), 1)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, trans = p[:d], p[d:].reshape(2, 2)
        u = z @ w
        good, logz, expected = forward_backward(u, lines, trans)
        value = logz - float(u @ y) - float((seen * trans).sum()) + 0.5 * ridge * float(p @ p)
        grad = np.r_[z.T @ (good - y), (expected - seen).ravel()] + ridge * p
        return value * scale, grad * scale

    p = np.zeros(d + 4)
    value, grad = loss(p)
    past: list = []
    for _ in range(steps):
        q, kept = grad.copy(), []
        for s, g, r in reversed(past):
            k = r * (s @ q)
            kept.append(k)
            q -= k * g
        if past:
            s, g, _ = past[-1]
            q *= (s @ g) / (g @ g)
        for (s, g, r), k in zip(past, reversed(kept)):
            q += s * (k - r * (g @ q))
        step, slope = 1.0, float(grad @ q)
        if slope <= 0:
            q, slope = grad, float(grad @ grad)
        while step > 1e-8:
            new = p - step * q
            v, g = loss(new)
            if v <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, dg = new - p, g - grad
        if s @ dg > 1e-12:
            past = [*past, (s, dg, 1.0 / (s @ dg))][-10:]
        done = value - v < 1e-7 * max(1.0, abs(value))
        p, value, grad = new, v, g
        if done:
            break
    return {"mean": mean, "dev": dev, "w": p[:d], "trans": p[d:].reshape(2, 2)}


def score(texts: list[bytes], model: dict) -> np.ndarray:
    """Length-weighted mean of each text's line marginals."""
    x, size, lines = line_features(texts)
    good, _, _ = forward_backward(with_neighbours((x - model["mean"]) / model["dev"], lines) @ model["w"], lines, model["trans"])
    weight = size + 1.0
    first = np.cumsum(lines) - lines
    return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)


def fold(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict:
    """Fit on at most ``sample`` labelled documents outside the held-out fold, those of the smallest id hash.

    Line features are computed on the executors; the driver gets features of the sampled texts only. Null labels and ids are
    passed over; an id with several labels counts by the largest. Without labels every text scores 0.5.
    """
    chosen = labels.select(F.col(id_col).alias("lid"), F.col(label_col).alias("y")).filter("lid is not null and y is not null").filter(fold("lid") != 0).groupBy("lid").agg(F.max("y").alias("y")).orderBy(F.xxhash64("lid"), "lid").limit(int(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, _, lines = line_features([t or b"" for t in b.column(1).to_pylist()])
            cuts = (np.cumsum(lines) - lines) * x.shape[1]
            packed = x.astype("<f4").ravel()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([v.tobytes() for v in np.split(packed, cuts[1:])], pa.binary())], ["id", "y", "x"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t")).join(F.broadcast(chosen), F.col("id") == F.col("lid")).select("id", "t", F.col("y").cast("int").alias("y"))
    got = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, y int, x binary").toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    xs = [np.frombuffer(v, "<f4").reshape(-1, len(NAMES)).astype(float) for v in got.column("x").to_pylist()]
    if not xs:
        d = len(NAMES)
        return {"mean": np.zeros(d), "dev": np.ones(d), "w": np.zeros(3 * d), "trans": np.zeros((2, 2))}
    y = (got.column("y").to_numpy() == 1).astype(int)
    return fit(np.vstack(xs), np.array([len(x) for x in xs]), y)


def add_score(df: DataFrame, model: dict, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The input with ``out_col`` (0 to 1) added from the whole text; null text scores as empty. All other columns, nulls and repeated rows pass through."""
    kept = [c for c in df.columns if c != out_col]
    plain = df.select(*[F.col(f"`{c}`") for c in kept])
    at, names = kept.index(text_col), [*kept, out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 1024):
                part = b.slice(low, 1024)
                texts = [(t or "").encode() for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.clip(score(texts, model), 0, 1), pa.float64())], names)

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(out_col, T.DoubleType())]))


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, held_out, score, predicted. Labels, language, source and id are no inputs of a score."""
    model = train(df, labels, id_col, text_col, sample=sample)
    out = add_score(df.select(F.col(id_col), F.col(text_col).cast("string").alias("__t")), model, "__t")
    return out.select(id_col, (fold(id_col) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
