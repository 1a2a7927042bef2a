import random

import numpy as np
from conftest import prose, table

from postlane.llm import repeats


def brute(docs, w):
    """{doc: words that lie in w words that another document has}, and who has them."""
    seen = {}
    for d, words in docs.items():
        for k in range(len(words) - w + 1):
            seen.setdefault(tuple(words[k : k + w]), set()).add(d)
    covered, others = {}, {}
    for d, words in docs.items():
        for k in range(len(words) - w + 1):
            rest = seen[tuple(words[k : k + w])] - {d}
            if rest:
                covered.setdefault(d, set()).update(range(k, k + w))
                others.setdefault(d, set()).update(rest)
    return covered, others


def check(spark, texts, w, anchor):
    rows = repeats.repeated_passages(table(spark, list(texts.items())), w, anchor).collect()
    got = {}
    for r in rows:
        places = set(range(r["start_word"], r["start_word"] + r["n_words"]))
        assert not places & got.get(r["doc_id"], set())
        got.setdefault(r["doc_id"], set()).update(places)
    want, others = brute({d: t.lower().split() for d, t in texts.items()}, w)
    assert got == want
    low = {d: t.lower().split() for d, t in texts.items()}
    seen = {}
    for d, words in low.items():
        for k in range(len(words) - w + 1):
            seen.setdefault(tuple(words[k : k + w]), set()).add(d)
    for r in rows:
        d, first = r["doc_id"], r["start_word"]
        assert r["partner"] == min(x for k in range(first, first + r["n_words"] - w + 1) for x in seen[tuple(low[d][k : k + w])] - {d})


def test_against_all_windows(spark):
    r = random.Random(3)
    shared = [prose(r, n) for n in (6, 9, 30, 5)]
    texts = {d - 20: " ".join(r.choice([prose(r, 8), r.choice(shared), "go go go go go go go"]) for _ in range(12)) for d in range(60)}
    for w, anchor in ((6, 3), (12, 4), (6, 6)):
        check(spark, texts, w, anchor)


def test_fifty_words_and_no_fewer(spark):
    r = random.Random(4)
    p50, p49 = prose(r, 50), prose(r, 49)
    texts = {0: f"a0 {p50} b0", 1: f"a1 {p50.upper()} b1", 2: f"a2 {p49} b2", 3: f"a3 {p49} b3", 4: prose(r, 400)}
    rows = {r["doc_id"]: tuple(r)[1:] for r in repeats.repeated_passages(table(spark, list(texts.items()))).collect()}
    assert rows == {0: (1, 50, 1), 1: (1, 50, 0)}


def batches_of(rows, w, size):
    """Batches (pool, at, doc, place) of (doc, words) in order of documents, some with their suffixes split between batches."""
    flat = [(d, k, words[k : k + w]) for d, words in rows for k in range(len(words) - w + 1)]
    for a in range(0, len(flat), size):
        part = flat[a : a + size]
        pool = np.array([x for _, _, words in part for x in words], ">u4")
        yield pool, np.arange(len(part)) * w, np.array([d for d, *_ in part]), np.array([k for _, k, _ in part])


def test_the_family_against_all_pairs(monkeypatch):
    r, w = random.Random(0), 4
    rows = [(d - 20, [r.choice((0, 1, 1 << 24, 255, 1 << 31)) for _ in range(r.randint(0, 30))]) for d in range(60)]
    rows[7:9] = [(rows[7][0], [5] * 20), (rows[8][0], [5] * 9 + [6])]
    seen = {}
    for d, words in rows:
        for k in range(len(words) - w + 1):
            seen.setdefault(tuple(words[k : k + w]), {}).setdefault(d, []).append(k)
    want = {(d, k): min(x for x in docs if x != d) for docs in seen.values() if len(docs) > 1 for d, places in docs.items() for k in places}
    for size, chunk in ((1, 3), (17, 1), (17, 5), (100, 1 << 16), (10_000, 4)):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        family, found, of = repeats.SuffixFamily(w), {}, {}
        for pool, at, doc, place in batches_of(rows, w, size):
            for d, k, other, group in zip(*(x.tolist() for x in family.add(pool, at, doc, place))):
                assert (d, k) not in found
                found[d, k] = other
                of.setdefault(group, set()).add((d, k))
        assert found == want
        assert sorted(map(sorted, of.values())) == sorted(sorted((d, k) for d, places in docs.items() for k in places) for docs in seen.values() if len(docs) > 1)
        sizes = [len(x) for x in family.levels]
        assert all(a > b for a, b in zip(sizes, sizes[1:]))
        for level in family.levels:
            keys = level.keys(slice(None))
            assert (keys[1:] >= keys[:-1]).all() and (level.head[1:] == (keys[1:] != keys[:-1])).all()
            words = keys.view(">u4").reshape(-1, w).tolist()
            text = dict(rows)
            assert all(text[d][k : k + w] == x for d, k, x in zip(level.doc.tolist(), level.place.tolist(), words))
            assert len(level.pool) <= w * len(level)


def test_a_passage_that_all_share_takes_the_room_of_one():
    family, words = repeats.SuffixFamily(50), np.arange(80, dtype=">u4")
    for d in range(0, 3000, 100):
        family.add(np.tile(words, 100), (np.arange(100)[:, None] * 80 + np.arange(31)).ravel(), np.repeat(np.arange(d, d + 100), 31), np.tile(np.arange(31), 100))
    assert sum(map(len, family.levels)) == 31 and sum(len(x.pool) for x in family.levels) == 80


def test_odd_tables(ugly, nothing):
    rows = {r["doc_id"]: tuple(r)[1:] for r in repeats.repeated_passages(ugly).collect()}
    assert rows == {1: (0, 80, 2), 2: (0, 80, 1)}  # rows without an id don't count, and 1 isn't its own partner
    assert repeats.repeated_passages(nothing).collect() == []


def test_every_pair_follows_from_the_groups(spark):
    r = random.Random(6)
    p = [prose(r, n) for n in (12, 9, 15)]
    texts = {d: " ".join([prose(r, 5), *r.sample(p, r.choice((1, 2, 3))), prose(r, 5)]) for d in range(25)}
    both = prose(r, 30).split()
    texts |= {30: " ".join(both), 31: " ".join(both[:20]), 32: " ".join(both[10:])}
    seen = {}
    for d, t in texts.items():
        words = t.split()
        for k in range(len(words) - 5):
            seen.setdefault(tuple(words[k : k + 6]), set()).add(d)
    want = {(a, b) for docs in seen.values() for a in docs for b in docs if a != b}
    rows = repeats.shared_passages(table(spark, list(texts.items())), 6, 3).collect()
    of = {}
    for x in rows:
        assert x["groups"] == sorted(set(x["groups"])) and len(x["groups"]) > 0
        for g in x["groups"]:
            of.setdefault(g, set()).add(x["doc_id"])
    assert {(a, b) for docs in of.values() for a in docs for b in docs if a != b} == want


def test_batches_that_come_later_meet_saved_levels(spark, nothing, tmp_path, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH", 40)
    r, w = random.Random(11), 6
    shared = [prose(r, n) for n in (6, 9, 14)]
    make = lambda: " ".join(r.choice([prose(r, 5), r.choice(shared)]) for _ in range(6))
    batches = [{d: make() for d in range(a, a + 8)} for a in (100, 0, 50)]
    family, so_far, got = None, {}, {}
    for k, texts in enumerate(batches):
        passages, family = repeats.extend(table(spark, list(texts.items())), str(tmp_path), family, 3, w, 3)
        so_far |= texts
        for p in passages.collect():
            got.setdefault(p["doc_id"], set()).update(range(p["start_word"], p["start_word"] + p["n_words"]))
            assert p["doc_id"] in so_far and p["partner"] in so_far and p["partner"] != p["doc_id"]
        want, _ = brute({d: t.lower().split() for d, t in so_far.items()}, w)
        assert got == want, k
    assert {x["shard"] for x in family.collect()} <= {0, 1, 2} and family.count() > 0
    passages, same = repeats.extend(nothing, str(tmp_path), family, None, w, 3)
    assert passages.collect() == [] and sorted(map(tuple, same.collect())) == sorted(map(tuple, family.collect()))
    passages, none = repeats.extend(nothing, str(tmp_path))
    assert passages.collect() == [] and none.collect() == []
