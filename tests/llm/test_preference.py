import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose, table
from pyspark.sql import functions as F

from postlane.llm import preference


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(8)
    docs, labels = [], []
    for k in range(700):
        words = prose(r, r.randint(20, 120)).split()
        kind = r.choice(("good", "good", "good", "toxic", "junk"))
        if kind == "toxic":
            for w in r.sample(["moron", "scum", "trash", "vermin"], 2):
                words.insert(r.randrange(len(words)), w)
        if kind == "junk":
            words = [w.upper() + "!!" for w in words]
        docs.append((k, " ".join(words)))
        labels.append((k, int(kind != "junk"), int(kind == "toxic")))
    return table(spark, docs), table(spark, labels, "doc_id bigint, quality int, toxic int")


def featured(texts):
    (b,) = preference._featured(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([""] * len(texts)), pa.array(texts, pa.string())], ["doc_id", "label", "text"])]))
    return np.stack([np.frombuffer(x) for x in b.column(2).to_pylist()]), [np.frombuffer(x, np.uint64) for x in b.column(3).to_pylist()]


def test_features_of_each_text_apart():
    texts = ["moron trash the the", None, "", "The end, of it all"] * 2
    shapes, words = featured(texts)
    for k, t in enumerate(texts):
        one, w = featured([t])
        assert shapes[k] == pytest.approx(one[0]) and words[k].tolist() == w[0].tolist() == sorted(set(w[0].tolist()))
    assert [len(w) for w in words[:4]] == [3, 0, 0, 5]


def test_held_out_documents(spark, corpus):
    docs, labels = corpus
    rows = preference.classify(docs, labels.where("doc_id < 450")).where("doc_id >= 450").join(labels, "doc_id").collect()
    good = [r["keep"] for r in rows if r["quality"] and not r["toxic"]]
    assert np.mean(good) > 0.97
    assert np.mean([r["keep"] for r in rows if r["toxic"]]) < 0.05
    assert np.mean([r["keep"] for r in rows if not r["quality"]]) < 0.05


def test_threshold_is_a_quantile_of_all_preferred_scores(corpus):
    docs, labels = corpus
    out = preference.classify(docs, labels, sample=200, loss=0.1)
    good = out.join(labels.where("quality = 1 AND toxic = 0"), "doc_id")
    lost = 1 - good.agg(F.avg(F.col("keep").cast("int"))).first()[0]
    assert 0.08 < lost <= 0.1 + 1e-9


def test_learning_ends_where_the_penalised_loss_has_no_slope():
    r = np.random.default_rng(0)
    dense = r.normal(size=(60, 3))
    x = preference._Sparse(dense, r.integers(0, 60, 200), r.integers(0, 5, 200), 5)
    better, worse = r.integers(0, 60, 300), r.integers(0, 60, 300)
    w = preference.bradley_terry(x, better, worse, l1=0.01, l2=0.01, rounds=3000)
    full = np.zeros((60, 8))
    full[:, :3] = dense
    np.add.at(full, (x.row, x.column + 3), 1)
    d = full[better] - full[worse]
    slope = -(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + 0.01 * w
    for s, v in zip(slope, w):
        assert abs(s + 0.01 * np.sign(v)) < 1e-4 if v else abs(s) <= 0.01 + 1e-4


def test_scores_are_those_of_the_features_one_by_one():
    texts = ["The moron; the end", "", None, "a a a b!", "Zusammengehörigkeit zusammen"]
    shapes, words = featured(["moron trash the", "the end of it all", "moron the", "end it the"] * 5)
    ranker = preference.fit(shapes, words, np.array([False, True, False, True] * 5))
    together = ranker.scores(pa.array(texts))
    assert together == pytest.approx([ranker.scores(pa.array([t], pa.string()))[0] for t in texts])
    assert together[0] < ranker.scores(pa.array(["The end; the end"]))[0]


def test_odd_tables(spark, ugly, nothing):
    labels = table(spark, [(1, 1, 0), (1, 1, 0), (2, 1, 0), (7, 0, 0), (8, 1, 1), (None, 1, 0), (6, None, 0), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    rows = preference.classify(ugly, labels).collect()
    assert len(rows) == ugly.count() and all(r["score"] is not None and r["keep"] is not None for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert all(r["keep"] for r in rows if r["doc_id"] in (1, 2))
    for few in (labels.where("quality = 1 AND toxic = 0"), labels.where("false")):
        assert all(r["keep"] and r["score"] == 0 for r in preference.classify(ugly, few).collect())
    assert preference.classify(nothing, labels).collect() == []
