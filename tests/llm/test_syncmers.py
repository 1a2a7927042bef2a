import random

import pyarrow as pa
import pytest
from conftest import prose, table

from postlane.llm import syncmers
from postlane.llm.words import ALNUM, Hasher, grams, lower, spans
import numpy as np


def brute(text, k, s):
    raw = np.frombuffer(text.encode(), np.uint8)
    low = lower(raw)
    starts, ends, _ = spans(low, np.array([0, len(raw)]), ALNUM)
    h = Hasher()(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    out = []
    for i in range(len(h) - k + 1):
        inner = [int(grams(h[j : j + s], s)[0]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, int(grams(h[i : i + k], k)[0])))
    return out


@pytest.mark.parametrize(("k", "s"), [(12, 4), (5, 2), (3, 3), (6, 1)])
def test_against_a_scan(k, s):
    r = random.Random(k)
    texts = [prose(r, n) for n in (0, 1, k - 1, k, k + 1, 90, 400)] + ["und und " * 30, None, "É, é! Été"]
    row, place, h, n = syncmers.anchors(pa.array(texts), k, s)
    for i, t in enumerate(texts):
        assert [(int(p), int(x)) for p, x in zip(place[row == i], h[row == i])] == brute(t or "", k, s)
        assert n[i] == len((t or "").replace(",", " ").replace("!", " ").split())


def test_shared_words_share_anchors_at_the_same_places(spark):
    r = random.Random(9)
    shared = prose(r, 60)
    docs = table(spark, [(1, f"{prose(r, 17)} {shared} {prose(r, 30)}"), (2, f"{prose(r, 5)} {shared.upper()}!"), (3, prose(r, 100)), (None, shared)])
    prints = syncmers.syncmers(docs)
    rows = syncmers.positional_matches(prints.where("doc_id = 1"), prints.where("doc_id > 1")).collect()
    want = len(brute(shared, syncmers.K, syncmers.S))
    assert want >= 5 and [(x["a"], x["b"], x["shift"], x["anchors"]) for x in rows] == [(1, 2, -12, want)]


def test_density():
    r = random.Random(2)
    row, *_ = syncmers.anchors(pa.array([" ".join(str(r.random()) for _ in range(20_000))]))
    assert len(row) / 40_000 == pytest.approx(2 / (syncmers.K - syncmers.S + 1), rel=0.1)


def test_odd_tables(ugly, nothing):
    rows = syncmers.syncmers(ugly).collect()
    assert len(rows) == ugly.count()
    assert all(r["places"] == [] for r in rows if r["doc_id"] in (3, 4, 5, 7))
    assert len({str(r) for r in rows if r["doc_id"] == 1}) == 1
    assert [r["n_words"] for r in rows if r["doc_id"] == 6] == [180_000]
    assert syncmers.syncmers(nothing).collect() == []
    with pytest.raises(ValueError):
        syncmers.syncmers(nothing, 3, 4)
