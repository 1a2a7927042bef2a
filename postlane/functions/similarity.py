"""Similarities: (frequency, document frequencies, length, mean length, documents) to a score, as columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, functions as F

Similarity = Callable[[Column, Sequence[Column], Column, Column, Column], Column]


def idf(dfs: Sequence[Column], n: Column) -> Column:
    """The sum over the words of ln(1 + (n - df + 0.5) / (df + 0.5)); that of a phrase is the sum of its words'."""
    return reduce(add, [F.log1p((n - d + 0.5) / (d + 0.5)) for d in dfs])


def _saturation(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    tf = tf.cast("double")
    norm = F.lit(float(k1)) * (F.lit(1.0 - b) + F.lit(float(b)) * dl / avgdl)
    return F.when((avgdl > 0) & (tf > 0), tf / (tf + norm)).otherwise(F.lit(0.0))


def _positive(score: Similarity) -> Similarity:
    """score, marked as one that gives a term that occurs more than 0, so that the best need no look at other documents."""
    score.positive = True
    return score


def bm25(k1: float = 1.2, b: float = 0.75) -> Similarity:
    return _positive(lambda tf, dfs, dl, avgdl, n: idf(dfs, n) * _saturation(tf, dl, avgdl, k1, b))


def bm25_impact(k1: float = 1.2, b: float = 0.75) -> Similarity:
    """What a word's frequency is worth, without how rare it is."""
    return _positive(lambda tf, dfs, dl, avgdl, n: _saturation(tf, dl, avgdl, k1, b))


def bm25_legacy(k1: float = 1.2, b: float = 0.75) -> Similarity:
    """The older form, (k1 + 1) times as large."""
    return _positive(lambda tf, dfs, dl, avgdl, n: idf(dfs, n) * _saturation(tf, dl, avgdl, k1, b) * F.lit(k1 + 1.0))


def classic() -> Similarity:
    """TF-IDF with the root of the frequency over the root of the length; a document without words scores 0."""

    def score(tf: Column, dfs: Sequence[Column], dl: Column, avgdl: Column, n: Column) -> Column:
        df = reduce(add, list(dfs))
        rare = F.log((n + 1.0) / (df + 1.0)) + 1.0
        return F.when(dl > 0, rare * F.sqrt(tf.cast("double")) / F.sqrt(dl.cast("double"))).otherwise(F.lit(0.0))

    return _positive(score)


def from_callable(score: Callable[..., pd.Series]) -> Similarity:
    """Any function of whole columns, as pandas Series, run on Arrow batches: (tf, [df, ...], dl, avgdl, n) to scores."""

    def apply(tf: Column, dfs: Sequence[Column], dl: Column, avgdl: Column, n: Column) -> Column:
        count = len(dfs)

        @F.pandas_udf("double")
        def batch(*columns: pd.Series) -> pd.Series:
            return pd.Series(score(columns[0], list(columns[1 : 1 + count]), *columns[1 + count :])).astype("float64")

        return batch(tf, *dfs, dl, avgdl, n)

    return apply


default_bm25 = bm25()
