from collections import Counter

import pytest

from postlane.plans.queries import QUERIES

HEAD = "all of these texts begin with eight words"
ROWS = {3: f"{HEAD} zebra apple", 5: f"{HEAD} apple", 8: f"{HEAD} apple zebra", 9: f"{HEAD} zebra", 11: HEAD, 12: "", 13: f"{HEAD} apple apple"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(ROWS.items()), "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    return path


def key(text):
    words = text.split()
    return " ".join(sorted(set(words))), len(words)


def test_texts_that_differ_after_eight_words(spark, folder):
    run = lambda name: QUERIES[name](spark, folder).collect()
    same = Counter(key(t) for t in ROWS.values() if t)
    assert {(r["terms"], r["doc_len"]): r["n"] for r in run("value_counts")} == same
    first = {k: min(d for d, t in ROWS.items() if key(t) == k) for k in same}
    assert {r["doc_id"]: (r["code"], r["n"]) for r in run("factorize")} == {d: (first[key(t)], same[key(t)]) if t else (-1, 0) for d, t in ROWS.items()}
    want = [(k, d, *key(ROWS.get(d, ""))) for k, d in enumerate([5, 3, 3, -1, 8])]
    assert sorted(tuple(r) for r in run("take_rows")) == want


def test_order_by_what_follows_eight_words(spark, folder):
    terms = sorted({w for t in ROWS.values() for w in t.split()})
    order = sorted(ROWS, key=lambda d: ([ROWS[d].split().count(w) for w in terms], d))
    got = QUERIES["sort_docs"](spark, folder).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == order
