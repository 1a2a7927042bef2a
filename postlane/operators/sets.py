"""Set operations on keyed postings: what merging sorted lists of words with a mask comes to as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def intersect(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The distinct keys of both."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")


def rows_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every row of left whose key right has."""
    return left.join(right.select(key).distinct(), key, "left_semi")


def adjacent(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): left's pairs for which right has the same key and the next value. An equi-join on value + 1."""
    after = right.select(key, (F.col(value) - 1).alias(value)).distinct()
    return left.select(key, value).distinct().join(after, [key, value], "left_semi")


def merge(left: DataFrame, right: DataFrame, distinct: bool = False) -> DataFrame:
    both = left.unionByName(right)
    return both.distinct() if distinct else both


def merge_counts(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """(key, count): the counts of both, summed."""
    return left.select(key, count).unionByName(right.select(key, count)).groupBy(key).agg(F.sum(count).alias(count))


def bits_set(x: Column) -> Column:
    return F.bit_count(x)
