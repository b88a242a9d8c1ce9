"""Answer metrics as expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from corvane.functions.text import metric_tokens, normalise, words


def exact_match(prediction: Column, truth: Column) -> Column:
    return (normalise(prediction) == normalise(truth)).cast("double")


def f1(prediction: Column, truth: Column) -> Column:
    """Harmonic mean of precision and recall over distinct tokens."""
    p, t = F.array_distinct(metric_tokens(prediction)), F.array_distinct(metric_tokens(truth))
    common = F.size(F.array_intersect(p, t))
    both_empty = (F.size(p) == 0) & (F.size(t) == 0)
    precision, recall = common / F.greatest(F.size(p), F.lit(1)), common / F.greatest(F.size(t), F.lit(1))
    return F.when(both_empty, 0.0).when(common == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def bleu(prediction: Column, truth: Column, order: int = 4) -> Column:
    """Mean of the logs of unclipped n-gram precisions, with brevity penalty; 0 if any order has no match.

    Tokens are made once a row; n-grams are looked up in a set, on Arrow batches: a list of them in SQL is searched from its start for each n-gram.
    """
    counts = _ngram_hits(order)(metric_tokens(prediction), metric_tokens(truth))

    def score(c: Column) -> Column:
        hits, p, t = [c[n - 1] for n in range(1, order + 1)], c[order], c[order + 1]
        used = F.least(p, F.lit(order))
        none = reduce(lambda a, b: a | b, [(F.lit(n) <= used) & (hits[n - 1] == 0) for n in range(1, order + 1)])
        logs = reduce(lambda a, b: a + b, [F.when(F.lit(n) <= used, F.ln(F.greatest(hits[n - 1], F.lit(1)) / F.greatest(p - (n - 1), F.lit(1)))).otherwise(0.0) for n in range(1, order + 1)])
        brevity = F.when(p >= t, 1.0).otherwise(F.exp(1 - t / F.greatest(p, F.lit(1))))
        return F.when((p == 0) | (t == 0) | none, 0.0).otherwise(brevity * F.exp(logs / used))

    return F.transform(F.array(counts), score)[0]


def _ngram_hits(order: int):
    """Of each row's two lists of tokens: how many n-grams of the first stand in the second, repeats counted, for n from 1 to ``order``, and the lists' lengths; null if either is."""

    def hits(p, t) -> list[int] | None:
        if p is None or t is None:
            return None
        p, t = p.tolist(), t.tolist()
        found = []
        for n in range(1, order + 1):
            there = set(zip(*(t[i:] for i in range(n))))
            found.append(sum(g in there for g in zip(*(p[i:] for i in range(n)))))
        return [*found, len(p), len(t)]

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(prediction: pd.Series, truth: pd.Series) -> pd.Series:
        return pd.Series([hits(p, t) for p, t in zip(prediction, truth)], dtype=object)

    return run


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word error rate: word edits over the reference's words (at least 1). A table of edits has no SQL expression of bounded cost; it runs on Arrow batches, a row of the table at a time."""
    return _word_edits(words(F.lower(reference)), words(F.lower(hypothesis))) / F.greatest(F.size(words(reference)), F.lit(1))


@F.pandas_udf(DoubleType())
def _word_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    def edits(r, h) -> float:
        if r is None or h is None:
            return float("nan")
        ids: dict = {}
        a, b = (np.array([ids.setdefault(w, len(ids)) for w in x], np.int64) for x in (r, h))
        row = np.arange(len(b) + 1)
        steps = np.arange(len(b) + 1)
        for i, w in enumerate(a.tolist(), 1):
            best = np.minimum(row + 1, np.r_[i, row[:-1] + (b != w)])
            best[0] = i
            row = np.minimum.accumulate(best - steps) + steps  # insertions along the row
        return float(row[-1])

    return pd.Series([edits(r, h) for r, h in zip(reference, hypothesis)], dtype=float)
