"""Phrase frequencies as expressions over the positions of a document's words."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def pairs_in_runs(places: Column) -> Column:
    """How many pairs of neighbours that share no word fit into sorted places: the sum over runs of half their length."""
    zero = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("pairs"))

    def step(acc: Column, p: Column) -> Column:
        run = F.when(p == acc["last"] + 1, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(p.alias("last"), run.alias("run"), (acc["pairs"] + F.when(run % 2 == 0, 1).otherwise(0)).alias("pairs"))

    return F.aggregate(places, zero, step, lambda acc: acc["pairs"])


def _shifted(places: Column, k: int) -> Column:
    return F.transform(places, lambda p: p - F.lit(k))


def exact(places: Sequence[Column], repeated_start: bool) -> Column:
    """Occurrences of the phrase whose n-th word has the n-th places; 0 where a word is missing.

    Where the first two words are the same, no more count than pairs of that word that don't overlap.
    """
    starts = [_shifted(p, k) for k, p in enumerate(places)]
    count = F.size(reduce(F.array_intersect, starts))
    if repeated_start:
        count = F.least(count, pairs_in_runs(places[0]))
    there = reduce(lambda a, b: a & b, [p.isNotNull() for p in places])
    return F.when(there, count).otherwise(F.lit(0))


def near(places: Sequence[Column], terms: Sequence[str], slop: int) -> Column:
    """Occurrences of the terms in any order within n - 1 + slop words of each other, never fewer than exact ones.

    Counted are disjoint windows, earliest end first, that hold a place of its own for each term. The places of all
    terms are sorted into one array that is folded: the state is the last places of each term, as many as it has in
    the phrase, the earliest first; a window is full when none is missing.
    """
    distinct = list(dict.fromkeys(terms))
    slots = [(k, j) for k, t in enumerate(distinct) for j in range(list(terms).count(t))]
    by_term = dict(zip(terms, places))
    marked = lambda k: lambda p: p.cast("bigint") * len(distinct) + k
    events = [F.transform(by_term[t], marked(k)) for k, t in enumerate(distinct)]
    merged = F.array_sort(F.concat(*events)) if len(events) > 1 else events[0]
    none = F.lit(-1).cast("bigint")
    zero = F.struct(F.lit(0).alias("n"), *(none.alias(f"s{k}_{j}") for k, j in slots))

    def step(acc: Column, e: Column) -> Column:
        p, of = F.floor(e / len(distinct)), e % len(distinct)
        last = {(k, j) for k, j in slots if (k, j + 1) not in slots}
        held = [F.when(of == k, p if (k, j) in last else acc[f"s{k}_{j + 1}"]).otherwise(acc[f"s{k}_{j}"]) for k, j in slots]
        first = F.least(*held) if len(held) > 1 else held[0]
        full = (first >= 0) & (p - first <= len(terms) - 1 + slop)
        return F.struct((acc["n"] + F.when(full, 1).otherwise(0)).alias("n"), *(F.when(full, none).otherwise(h).alias(f"s{k}_{j}") for h, (k, j) in zip(held, slots)))

    there = reduce(lambda a, b: a & b, [p.isNotNull() for p in places])
    count = F.when(there, F.aggregate(merged, zero, step, lambda acc: acc["n"])).otherwise(F.lit(0))
    if len(distinct) == len(terms):
        return count  # exact ones lie apart, and the earliest ends leave no fewer windows
    return F.greatest(count, exact(places, terms[0] == terms[1]))
