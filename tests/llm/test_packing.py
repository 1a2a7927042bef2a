import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import table

from postlane.llm import packing


def bfd(sizes, capacity):
    bins, loads = [], []
    packing.best_fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sizes, capacity, bins, loads)
    return len(bins)


def sound(solution, sizes, capacity):
    assert sorted(i for b in solution.bins for i in b) == list(range(len(sizes)))
    assert solution.loads == [sum(sizes[i] for i in b) for b in solution.bins]
    assert all(0 < x <= capacity for x in solution.loads)


def test_best_fit_against_a_scan():
    r = random.Random(0)
    sizes = [r.randint(1, 60) for _ in range(200)]
    bins, loads = [], []
    packing.best_fit(list(range(200)), sizes, 100, bins, loads)
    naive = []
    for s in sizes:
        fits = [k for k, x in enumerate(naive) if x + s <= 100]
        if fits:
            naive[max(fits, key=lambda k: naive[k])] += s
        else:
            naive.append(s)
    assert sorted(loads) == sorted(naive)


def test_children_are_sound_and_carry_whole_bins():
    r = random.Random(1)
    sizes = [r.randint(30, 70) for _ in range(120)]
    found = packing.evolve(sizes, [], 100, r, 6, 0)
    for _ in range(30):
        a, b = r.sample(found, 2)
        child = packing.crossover(a, b, sizes, 100, r)
        sound(child, sizes, 100)
        assert {frozenset(x) for x in child.bins} & {frozenset(x) for x in b.bins}
        sound(packing.mutate(child, sizes, 100, r), sizes, 100)


def test_it_beats_best_fit_decreasing_where_that_fails():
    r, sizes = random.Random(11), []
    for _ in range(20):  # full bins of three, so that 20 bins are enough
        a = r.randint(26, 49)
        b = r.randint(26, 99 - a - 1)
        sizes += [a, b, 100 - a - b]
    best = packing.evolve(sizes, [], 100, random.Random(1), 8, 400)[0]
    sound(best, sizes, 100)
    assert len(best.bins) == 20 < bfd(sizes, 100)


def test_the_whole(spark):
    r = random.Random(2)
    rows = [(k, r.choice((3, 40, 70, 99, 100, 230, 600))) for k in range(700)]
    packed = packing.pack(table(spark, rows, "doc_id bigint, words bigint"), 100, shard=120, islands=3, epochs=2, children=6).collect()
    loads, pieces = defaultdict(int), defaultdict(list)
    for x in packed:
        loads[x["bin_id"]] += x["words"]
        pieces[x["doc_id"]].append((x["piece"], x["begin"], x["words"]))
    assert max(loads.values()) <= 100
    for k, n in rows:
        assert sorted(pieces[k]) == [(j, 100 * j, min(100, n - 100 * j)) for j in range(-(-n // 100))]
    assert len(loads) <= -(-sum(n for _, n in rows) // 100) * 1.35
    again = packing.pack(table(spark, rows, "doc_id bigint, words bigint").repartition(3), 100, shard=120, islands=3, epochs=2, children=6).where("bin_id >= 0").collect()
    assert sorted(map(tuple, again)) == sorted(tuple(x) for x in packed if x["bin_id"] >= 0)


def test_migration_keeps_the_best(spark):
    sizes = [random.Random(k).randint(1, 70) for k in range(150)]
    rows = [(k, s) for k, s in enumerate(sizes)]
    got = packing.pack(table(spark, rows, "doc_id bigint, words bigint"), 100, shard=10_000).select("bin_id").distinct().count()
    assert got <= bfd(sizes, 100)


def test_words_are_counted_whole(ugly):
    rows = {(r["doc_id"], r["words"]) for r in packing.word_counts(ugly).collect()}
    assert {(6, 180_000), (3, 0), (4, 0), (5, 0), (7, 1), (1, 80), (None, 80), (None, 0)} <= rows


def test_odd_tables(spark, ugly, nothing):
    packed = packing.pack(packing.word_counts(ugly)).collect()
    assert sorted((x["turn"], x["words"]) for x in packed if x["doc_id"] == 1) == [(1, 80), (2, 80)]
    assert sum(x["words"] for x in packed if x["doc_id"] == 6) == 180_000
    assert not {x["doc_id"] for x in packed} & {3, 4, 5}
    assert [x["words"] for x in packed if x["doc_id"] is None] == [80]
    assert packing.pack(packing.word_counts(nothing)).collect() == []
    assert packing.pack(table(spark, [(1, -3), (2, None)], "doc_id bigint, words bigint")).collect() == []
    with pytest.raises(ValueError):
        packing.pack(table(spark, [], "doc_id bigint, words bigint"), 0)
    assert isinstance(packing.fitness([], 10), float) and np.isfinite(packing.fitness([10], 10))
