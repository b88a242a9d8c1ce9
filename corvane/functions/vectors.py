"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

import hashlib
import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from corvane.functions.text import tokens

DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def place(token: str) -> tuple[int, float]:
    """Dimension and sign of a token."""
    h = hashlib.md5(token.encode()).hexdigest()
    return int(h[:8], 16) % DIMENSIONS, 1.0 if h[8] < "8" else -1.0


def _vector(toks, places: dict) -> list[float]:
    """places: dimension and sign of the tokens seen so far in a batch."""
    v = [0.0] * DIMENSIONS
    for t in () if toks is None else toks:
        if t not in places:
            places[t] = place(t)
        i, sign = places[t]
        v[i] += sign
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


@F.pandas_udf(ArrayType(DoubleType()))
def _hash_tokens(lists: pd.Series) -> pd.Series:
    places: dict = {}
    return lists.map(lambda toks: _vector(toks, places))


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def _hash_token_lists(lists: pd.Series) -> pd.Series:
    places: dict = {}
    return lists.map(lambda many: [_vector(toks, places) for toks in (() if many is None else many)])


def similarity_to_previous(dimension: np.ndarray, sign: np.ndarray, tokens: np.ndarray, digits: int = 9, at_once: int = 8192) -> np.ndarray:
    """The cosine of each text's :func:`hashed_embedding` and that of the text before it (the first: 0), rounded half up.

    dimension and sign of all tokens, in order; ``tokens``: how many each text has. The vectors of ``at_once`` texts are held at a time; sums run in the order of :func:`cosine`.
    """
    out, ends = np.zeros(len(tokens)), np.r_[0, np.cumsum(tokens)]
    for low in range(0, len(tokens) - 1, at_once):
        high = min(low + at_once + 1, len(tokens))
        part, owner = slice(ends[low], ends[high]), np.repeat(np.arange(high - low), tokens[low:high])
        v = np.bincount(dimension[part] * (high - low) + owner, weights=sign[part], minlength=DIMENSIONS * (high - low)).reshape(DIMENSIONS, -1)
        length = np.sqrt((v * v).sum(axis=0))
        v = np.divide(v, length, out=v, where=length > 0)
        squares, dots = np.zeros(high - low), np.zeros(high - low - 1)
        for x in v:
            squares += x * x
            dots += x[1:] * x[:-1]
        n = np.sqrt(squares)
        n = n[1:] * n[:-1]
        out[low + 1 : high] = np.divide(dots, n, out=np.zeros_like(dots), where=n != 0)
    scaled = np.abs(out) * 10.0**digits
    near = np.flatnonzero(np.abs(scaled % 1 - 0.5) < 1e-6)  # products may fall on either side of a half
    halves = [float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for x in out[near].tolist()]
    out = np.copysign(np.rint(scaled) / 10.0**digits, out)
    out[near] = halves
    return out


def hashed_embedding(text: Column) -> Column:
    """Signed feature hashing of the tokens into 64 dimensions, of unit length: a stand-in for a neural embedding, whose scores it does not resemble.

    md5 of a token gives its dimension (first eight hex digits) and its sign (ninth digit). It runs on Arrow batches, as a neural embedder would.
    """
    return _hash_tokens(tokens(text))


def hashed_embeddings(texts: Column) -> Column:
    """The embeddings of an array of texts."""
    return _hash_token_lists(F.transform(texts, tokens))
