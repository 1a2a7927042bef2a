import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from conftest import prose, table

from postlane.llm import golay, near_duplicates as nd


def test_the_code_is_perfect():
    r = np.random.default_rng(0)
    assert (golay._LEADERS >= 0).all() and len(set(golay._LEADERS.tolist())) == 2048
    words = r.integers(0, 1 << 23, 500)
    for k in range(4):
        flips = np.array([sum(1 << int(b) for b in r.choice(23, k, replace=False)) for _ in words])
        code = words ^ golay._LEADERS[golay.syndrome(words)]
        assert (golay.syndrome(code) == 0).all()
        assert (golay.decode(code ^ flips) == golay.decode(code)).all()


def test_two_errors_leave_an_index_in_common():
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 23, 3000)
    flips = np.array([sum(1 << int(b) for b in r.choice(23, r.integers(0, 3), replace=False)) for _ in words])
    (a, ma), (b, mb) = golay.indices(words), golay.indices(words ^ flips)
    assert all(set(a[k][ma[k]]) & set(b[k][mb[k]]) for k in range(len(words)))
    assert set(ma.sum(axis=1).tolist()) == {1, 6}


def hamming(x, y):
    return sum(int(a ^ b).bit_count() for a, b in zip(x, y))


def test_pairs_against_all_pairs(spark):
    r = random.Random(2)
    prints = {}
    for k in range(60):
        base = [r.getrandbits(64) for _ in range(4)]
        prints[k * 10] = base
        for j in range(1, 6):
            p = r.choice((0.01, 0.03, 0.06, 0.09, 0.14))
            prints[k * 10 + j] = [w ^ sum(1 << b for b in range(64) if r.random() < p) for w in base]
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    df = table(spark, [(k, *map(signed, v), 9) for k, v in prints.items()], nd._SCHEMA)
    want = {}
    for a, b in itertools.combinations(sorted(prints), 2):
        d = hamming(prints[a], prints[b])
        if d <= nd.NEAR_WIDE:
            want[a, b] = d
    for group in (nd.GROUP, 3):  # at 3, buckets are split into cells of two groups
        rows = nd.wide_pairs(df, group=group).collect()
        got = {(x["a"], x["b"]): x["bits"] for x in rows}
        assert len(rows) == len(got)  # each pair once
        assert set(got) <= set(want) and all(got[p] == want[p] for p in got)
        assert {p for p in want if want[p] < 30} <= set(got)  # by the pigeonhole principle
        assert len(got) >= 0.95 * len(want)


def test_numbers_of_words_must_be_alike(spark):
    rows = [(1, 5, 9, 1, 1, 10), (2, 5, 9, 1, 3, 8), (3, 5, 9, -1, -1, 10), (4, 5, 9, 1, 1, 7)]
    assert [(x["a"], x["b"], x["bits"]) for x in nd.wide_pairs(table(spark, rows, nd._SCHEMA)).orderBy("a").collect()] == [(1, 2, 1), (2, 4, 1)]


def test_indices_against_decoding_each_neighbour():
    words = np.random.default_rng(7).integers(0, 1 << 23, 2000)
    index, use = golay.indices(words)
    for x, i, m in zip(words, index, use):
        want = {int(golay.decode(np.array([x ^ e]))[0]) for e in [0, *(1 << b for b in range(23))]}
        assert set(i[m].tolist()) == want and m.sum() == len(want)


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(-30, 300), r.randrange(-30, 300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(80)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in nd.components(table(spark, edges, "a bigint, b bigint")).collect()}
    assert {x: y for x, y in got.items() if x != y} == {x: find(x) for x in root if find(x) != x}
    assert nd.components(table(spark, [], "a bigint, b bigint")).collect() == []


def copies(r, text, share):
    return " ".join(r.choice(("lantern77", "meadow", "of")) if r.random() < share else w for w in text.split())


def test_copies_are_found_and_others_left_alone(spark):
    r = random.Random(4)
    rows, group = [], {}
    for k in range(150):
        text = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(r.randint(60, 300)))
        rows.append((10 * k, text))
        group[10 * k] = 10 * k
        for j in range(1, r.choice((1, 1, 2, 4))):
            rows.append((10 * k + j, r.choice((text, text.upper() + "!", copies(r, text, 0.03)))))
            group[10 * k + j] = 10 * k
    got = {x["doc_id"]: x["duplicate_of"] for x in nd.near_duplicates(table(spark, rows)).collect()}
    assert all(group[a] == b for a, b in got.items())
    later = [x for x in group if group[x] != x]
    assert len(got) >= 0.95 * len(later)
    sig, n = nd.signatures(pa.array([t for _, t in rows]))
    text = {d: (n[k], *sig[k].tolist()) for k, (d, _) in enumerate(rows)}
    near = lambda a, b: hamming(a[1:], b[1:]) <= nd.NEAR_WIDE and min(a[0], b[0]) >= nd.NEAR_SIZE * max(a[0], b[0])
    for x in nd.near_duplicates(table(spark, rows)).collect():
        own = text[x["doc_id"]]
        assert x["links"] == sum(near(own, t) for t in set(text.values()) - {own})
    kept = {x["doc_id"] for x in nd.keep_first(table(spark, rows)).collect()}
    assert kept == set(group) - set(got)


def test_bits_against_a_sum_over_words():
    from postlane.llm.common import mix
    from postlane.llm.words import Hasher

    text = "One two, THREE two seventeen-hundreds"
    sums = np.zeros(256)
    for w in {"one", "two", "three", "seventeen", "hundreds"}:
        h = Hasher()(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))
        bits = np.concatenate([np.unpackbits(mix(h + np.uint64(k + 1)).view(np.uint8), bitorder="little") for k in range(4)])
        sums += (2.0 * bits - 1) * min(len(w), 10) ** 2
    (sig,), (n,) = nd.signatures(pa.array([text]))
    assert n == 5 and (np.unpackbits(sig.view(np.uint8), bitorder="little") == (sums > 0)).all()
    block = pa.array(["", text, None, "x " * 1000, text.lower()])
    sig2, n2 = nd.signatures(block)
    assert (sig2[1] == sig).all() and (sig2[4] == sig).all() and n2.tolist() == [0, 5, 0, 1, 5]


def test_odd_tables(ugly, nothing):
    got = {x["doc_id"]: (x["duplicate_of"], x["bits"], x["links"]) for x in nd.near_duplicates(ugly).collect()}
    assert got == {2: (1, 0, 0)}
    kept = nd.keep_first(ugly)
    assert kept.columns == ugly.columns
    ids = [str(x["doc_id"]) for x in kept.collect()]
    assert sorted(ids) == sorted(["1", "3", "4", "5", "6", "7", "8", "None", "None"])
    assert nd.near_duplicates(nothing).collect() == [] and nd.keep_first(nothing).collect() == []


def test_recall_against_all_pairs_by_distance(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, (400, 4), dtype=np.uint64)
    rows, want = [], {}
    for k, words in enumerate(base):
        flips = np.zeros(256, np.uint8)
        flips[r.choice(256, r.integers(1, nd.NEAR_WIDE + 9), replace=False)] = 1
        other = words ^ np.packbits(flips, bitorder="little").view(np.uint64)
        rows += [(2 * k, *words.view(np.int64).tolist(), 9), (2 * k + 1, *other.view(np.int64).tolist(), 9)]
    every = [[int(w) & (1 << 64) - 1 for w in row[1:5]] for row in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (d := hamming(every[a], every[b])) <= nd.NEAR_WIDE:
            want[a, b] = d
    got = {(x["a"], x["b"]): x["bits"] for x in nd.wide_pairs(table(spark, rows, nd._SCHEMA)).collect()}
    assert set(got) <= set(want) and all(got[p] == want[p] for p in got)
    assert all(p in got for p in want if want[p] < 30)  # by the pigeonhole principle
    for low, high in ((1, 29), (30, 39), (40, 46), (47, nd.NEAR_WIDE)):
        band = [p for p in want if low <= want[p] <= high]
        assert len(band) >= 20 and sum(p in got for p in band) >= 0.9 * len(band), (low, high)


def peak(run):
    tracemalloc.start()
    out = run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_memory_of_signatures():
    r = random.Random(6)
    text = pa.array([" ".join(f"{r.getrandbits(40):x}" for _ in range(20_000)) for _ in range(16)])
    (sig, n), most = peak(lambda: nd.signatures(text))
    assert n.tolist() == [20_000] * 16 and most < 50e6


def family(r, n, flips):
    """Fingerprints that differ from the first in up to `flips` bits."""
    out = np.repeat(r.integers(0, 1 << 63, (1, 4), dtype=np.uint64), n, axis=0)
    for k in range(1, n):
        bits = np.zeros(256, np.uint8)
        bits[r.choice(256, r.integers(1, flips + 1), replace=False)] = 1
        out[k] ^= np.packbits(bits, bitorder="little").view(np.uint64)
    return out


def dealt(words):
    """Batches of cells, as a task of the search gets them."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(words))), *(pa.array(words[:, k].view(np.int64)) for k in range(4)), pa.array([9] * len(words))], ["doc_id", "w0", "w1", "w2", "w3", "n"])
    cells = pa.Table.from_batches(nd._deal(np.ones((nd.SEGMENTS - 1) * nd.INDICES, np.int64))(iter([batch])))
    return cells.sort_by("cell").to_batches(1000)


def test_memory_of_a_large_family():
    cells = dealt(family(np.random.default_rng(8), 2000, 12))
    rows, most = peak(lambda: sum(b.num_rows for b in nd._search(nd.NEAR_WIDE, nd.NEAR_SIZE)(iter(cells))))
    assert rows == 2000 * 1999 // 2 and most < 120e6


def test_links_stand_for_all_pairs(spark):
    words = np.concatenate([family(np.random.default_rng(k), n, 14) for k, n in ((1, 300), (2, 40), (3, 1))])
    df = table(spark, [(k, *w, 9) for k, w in enumerate(words.view(np.int64).tolist())], nd._SCHEMA)
    pairs = {(x["a"], x["b"]) for x in nd.wide_pairs(df).collect()}
    assert pairs == {*itertools.combinations(range(300), 2), *itertools.combinations(range(300, 340), 2)}
    for group in (nd.GROUP, 50):
        rows = nd.wide_links(df, group=group)
        got = rows.collect()
        if group == nd.GROUP:
            assert len(got) < len(pairs) / 4
        links = {}
        for x in got:
            links[x["a"]] = links.get(x["a"], 0) + x["links"]
        assert links == {k: 299 if k < 300 else 39 for k in range(340)}
        assert {x["node"]: x["root"] for x in nd.components(rows).collect()} == {k: 0 if k < 300 else 300 for k in range(340) if k not in (0, 300)}
