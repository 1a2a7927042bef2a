import math
from collections import defaultdict

import numpy as np
import pytest
from conftest import table

from postlane.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, "x" * (10 + k % 7), "hot" if k < 300 else f"s{k % 4}") for k in range(500)]
    return table(spark, rows, "doc_id bigint, text string, source string").repartition(3)


def counted(df):
    return {(r["doc_id"], r["turn"]): (r["source"], r["copies"]) for r in df.collect()}


def test_one_pass_keeps_the_sum_and_the_expectation():
    p = np.array([0.3, 0.9, 0.0, 1.0, 0.5, 0.5, 0.2, 0.6])
    mean = np.zeros(len(p))
    for seed in range(4000):
        out, held, a = mixing.pivotal(p, np.random.default_rng(seed).random(len(p)))
        whole = np.where(out < 0, 0.0, out)
        if held >= 0:
            whole[held] = a
        assert whole.sum() == pytest.approx(p.sum())
        assert (out < 0).sum() <= 1 and out[2] == 0 and out[3] == 1
        mean += whole / 4000
    assert mean == pytest.approx(p, abs=0.03)


@pytest.mark.parametrize("leaf", [7, 60, 100_000])
def test_sums_hold_in_each_source_and_in_all(docs, leaf):
    rates = mixing.source_rates(docs)
    rate = {r["source"]: r["rate"] for r in rates.collect()}
    rows = counted(mixing.copies(docs, rates, leaf=leaf, fan_in=3))
    assert len(rows) == 500
    per, n = defaultdict(int), defaultdict(int)
    for source, c in rows.values():
        assert c in (math.floor(rate[source] + 1e-9), math.ceil(rate[source] - 1e-9))
        per[source] += c
        n[source] += 1
    for s in per:
        assert abs(per[s] - n[s] * rate[s]) < 1
    assert abs(sum(per.values()) - sum(n[s] * rate[s] for s in n)) < 1


def test_target_shares_and_no_document_lost(docs):
    rate = {r["source"]: r["rate"] for r in mixing.source_rates(docs).collect()}
    assert min(rate.values()) == pytest.approx(1, abs=1e-6) and rate["hot"] == min(rate.values())
    size = defaultdict(float)
    for r in docs.collect():
        size[r["source"]] += len(r["text"])
    want = {s: x**mixing.POWER for s, x in size.items()}
    got = {s: x * rate[s] for s, x in size.items()}
    for s in size:
        assert got[s] / sum(got.values()) == pytest.approx(want[s] / sum(want.values()), rel=1e-6)
    given = {r["source"]: r["rate"] for r in mixing.source_rates(docs, {"hot": 1, "s1": 3}, total=100).collect()}
    assert given["s0"] == 0 and given["s1"] * size["s1"] == pytest.approx(75, rel=1e-6)
    with pytest.raises(ValueError):
        mixing.source_rates(docs, {"hot": -1})


def test_the_same_on_other_partitions_and_unbiased_over_seeds(spark, docs):
    rates = table(spark, [("hot", 0.4), ("s0", 1.25)], "source string, rate double")
    some = docs.where("doc_id < 30 OR source = 's0'")
    a = counted(mixing.copies(some, rates, leaf=8))
    assert a == counted(mixing.copies(some.repartition(7), rates, leaf=8))
    rows = [counted(mixing.copies(some.limit(40).coalesce(1), rates, seed=s, leaf=1000)) for s in range(6)]
    mean = np.mean([[c for _, c in sorted((k, v[1]) for k, v in r.items() if v[0] == "hot")] for r in rows])
    assert mean == pytest.approx(0.4, abs=0.06)
    assert all(c == 0 for s, c in counted(mixing.copies(docs.where("source = 's1'"), rates)).values())


def brute(units, rates, seed, leaf, fan_in, leaf_of, source_leaf_of):
    """The whole tree by plain lists: {unit: copies} of units (source, doc_id, turn)."""
    fine = lambda p: mixing._EPS < p < 1 - mixing._EPS
    out = {u: math.floor(rates[u[0]] + mixing._EPS) for u in units}
    p = {u: max(rates[u[0]] - out[u], 0.0) for u in units}
    level = 0

    def node(members):
        held = None
        for u in sorted(members):
            if not fine(p[u]):
                out[u] += round(p[u])
                continue
            if held is None:
                held = u
                continue
            a, b = p[held], p[u]
            draw = float(mixing.uniform(seed, level, np.array([u[1]]), np.array([u[2]]))[0])
            s = a + b
            first_ends = draw * s < b if s < 1 else draw * (2 - s) < 1 - b
            ends, stays = (held, u) if first_ends else (u, held)
            out[ends] += 0 if s < 1 else 1
            p[stays], held = (s if s < 1 else s - 1), stays
            if not fine(p[stays]):
                out[stays] += 1 if p[stays] > 0.5 else 0
                held = None
        return [] if held is None else [held]

    def pass_over(left, key):
        groups = defaultdict(list)
        for u in left:
            groups[key(u)].append(u)
        return [u for g in groups.values() for u in node(g)]

    left, at, width = [u for u in units if fine(p[u])], {u: leaf_of(u) for u in units}, max(math.ceil(sum(u[0] == s for u in units) / leaf) for s in rates)
    while True:
        left = pass_over(left, lambda u: (u[0], at[u]))
        level += 1
        if width <= 1:
            break
        width, at = math.ceil(width / fan_in), {u: a // fan_in for u, a in at.items()}
    width = math.ceil(len(rates) / leaf)
    at = {u: source_leaf_of(u, width) for u in units}
    while True:
        left = pass_over(left, lambda u: at[u])
        level += 1
        if width <= 1:
            break
        width, at = math.ceil(width / fan_in), {u: a // fan_in for u, a in at.items()}
    for u in left:
        out[u] += int(mixing.uniform(seed, -1, u[1], u[2]) < p[u])
    return out


def test_copies_against_plain_lists(spark):
    rates = {"a": 1.3, "b": 0.45, "c": 2.0, **{f"t{k}": 0.1 + 0.17 * k for k in range(9)}}
    rows = [(k, x) for k, x in enumerate([*["a"] * 70, *["b"] * 23, *["c"] * 4, *(f"t{k}" for k in range(9)), "b", "b"])] + [(92, "b"), (92, "b")]
    docs = table(spark, rows, "doc_id bigint, source string")
    leaf, fan_in, seed = 5, 3, 23
    got = {(r["source"], r["doc_id"], r["turn"]): r["copies"] for r in mixing.copies(docs, table(spark, list(rates.items()), "source string, rate double"), seed, leaf, fan_in).collect()}
    n = {s: sum(x == s for _, x in rows) for s in rates}
    u = table(spark, [(s, d, t, math.ceil(n[s] / leaf)) for s, d, t in got], "source string, doc_id bigint, turn int, n bigint")
    hashed = {(r["source"], r["doc_id"], r["turn"]): r for r in u.selectExpr("*", f"pmod(xxhash64(doc_id, turn, {seed}), n) AS leaf", f"xxhash64(source, {seed}) AS h").collect()}
    want = brute(list(got), rates, seed, leaf, fan_in, lambda k: hashed[k]["leaf"], lambda k, w: hashed[k]["h"] % w)
    assert got == want
    assert sum(got.values()) == pytest.approx(sum(n[s] * r for s, r in rates.items()), abs=1)


def test_rows_that_repeat_an_id_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr("postlane.llm.common.ARRAY", 3)
    docs = table(spark, [(1, "s", "b"), (1, "s", "a"), (1, "s", "c"), (2, "s", "z"), (3, "t", "y")], "doc_id bigint, source string, text string")
    counted = table(spark, [(1, "s", 1, 8), (1, "s", 2, 7), (1, "s", 3, 8), (2, "s", 1, 0), (3, "t", 1, 3)], "doc_id bigint, source string, turn int, copies bigint")
    out = [r["text"] for r in mixing.repeat(docs, counted).collect()]
    assert {t: out.count(t) for t in "abczy"} == {"a": 7, "b": 8, "c": 8, "z": 0, "y": 3}
    assert sorted(r["turn"] for r in mixing.copies(docs, table(spark, [("s", 1.0)], "source string, rate double")).collect()) == [1, 1, 1, 2, 3]


def test_columns_of_any_name(spark):
    names = ["d", "s", "low", "more", "rows", "turn", "copy", "node", "leaf", "p", "up", "__n", "__copy", "__turn", "__d", "__s", "__all", "name"]
    docs = table(spark, [(k, "text", f"s{k % 2}", *[f"v{k}"] * len(names)) for k in range(6)], "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    out = mixing.repeat(docs, mixing.mix(docs))
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in docs.collect()}


def test_odd_tables(ugly, nothing):
    mixed = mixing.mix(ugly)
    rows = mixed.collect()
    assert len(rows) == ugly.count() and all(r["copies"] >= 1 for r in rows)
    assert sorted(r["turn"] for r in rows if r["doc_id"] == 1) == [1, 2]
    out = mixing.repeat(ugly, mixed)
    assert out.columns == ugly.columns and out.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(nothing).collect() == []
    assert mixing.repeat(nothing, mixing.mix(nothing)).collect() == []
