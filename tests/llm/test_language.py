import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import table
from pyspark.sql import functions as F

from postlane.llm import language
from postlane.llm.common import pick_rows

PARTS = {"en": "the and ing tion with er on was that ly", "de": "der und ung sch ein keit lich ver ist zu", "fr": "le les eau tion des ment que aux et oi"}


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(6)
    rows = [(k, " ".join("".join(r.choice(PARTS[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60))), lang) for k, lang in enumerate(r.choice(list(PARTS)) for _ in range(600))]
    return table(spark, rows, "doc_id bigint, text string, lang string")


@pytest.fixture(scope="module")
def model(docs):
    return language.train(docs.where("doc_id < 400"))


def test_held_out_accuracy_and_sparsity(docs, model):
    rows = language.identify(docs.where("doc_id >= 400"), model).join(docs, "doc_id").collect()
    right = np.array([r["language"] == r["lang"] for r in rows])
    assert right.mean() > 0.97
    assert (model.weights != 0).mean() < 0.2
    assert np.mean([r["confidence"] for r in rows]) == pytest.approx(right.mean(), abs=0.08)


def counts(texts):
    """{row: {bucket: count}}"""
    out = {}
    for _, _, row, bucket, n in language.ngram_counts(pa.array(texts, pa.string())):
        for r, b, c in zip(row.tolist(), bucket.tolist(), n.tolist()):
            out.setdefault(r, {})[b] = c
    return out


def bucket_of(gram):
    code = 0
    for c in gram:
        code = (code * 0x01000193 + ord(c) + 1) & 0xFFFFFFFF
    h = (code * 0x9E3779B1 & 0xFFFFFFFF) ^ (len(gram) * 0x85EBCA6B & 0xFFFFFFFF)
    h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
    return (h ^ h >> 13) % language.BUCKETS


def brute(text):
    flat = "".join(x if len(x := c.lower()) == 1 and x.isalpha() else c if c.isalpha() else " " for c in text or "")
    out = Counter(bucket_of(flat[k : k + n]) for n in (1, 2, 3) for k in range(len(flat) - n + 1) if flat[k : k + n].strip())
    return dict(out)


def test_idf_counts_all_documents(docs):
    idf = language.inverse_document_frequency(docs)
    df = np.zeros(language.BUCKETS)
    for found in counts([r["text"] for r in docs.collect()]).values():
        df[list(found)] += 1
    assert idf == pytest.approx(np.log(601 / (1 + df)) + 1)


TEXTS = ["Ab, éa", None, "", "12 .. ", "Привет, МИР", "日本語の文 ok", "a\U00020000b 🙂 x", "ÀÉ\u2014straße ŁÓDŹ", "z"]


def test_ngrams_of_characters_against_a_scan(monkeypatch):
    want = {k: found for k, t in enumerate(TEXTS) if (found := brute(t))}
    assert counts(TEXTS) == want
    for piece in (1, 2, 5, 20):  # blocks of a text or two, long ones cut into pieces
        monkeypatch.setattr(language, "_PIECE", piece)
        assert counts(TEXTS) == want


def test_learning_against_plain_loops():
    r = np.random.default_rng(3)
    data = [(np.sort(r.choice(12, 4, replace=False)), r.random(4), int(r.integers(0, 3))) for _ in range(40)]
    alpha, beta, l1, l2 = 0.7, 1.0, 0.05, 0.1
    z, n = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(12)]

    def weight(i, c):
        return 0.0 if abs(z[i][c]) <= l1 else -(z[i][c] - math.copysign(l1, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    rng = np.random.default_rng(5)
    for _ in range(2):
        for k in rng.permutation(len(data)):
            at, x, y = data[k]
            w = [[weight(i, c) for c in range(3)] for i in at]
            logit = [sum(v * w[j][c] for j, v in enumerate(x)) for c in range(3)]
            whole = sum(math.exp(v) for v in logit)
            for j, i in enumerate(at):
                for c in range(3):
                    g = x[j] * (math.exp(logit[c]) / whole - (c == y))
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha
                    z[i][c] += g - sigma * w[j][c]
                    n[i][c] += g * g
    got = language.follow_the_regularised_leader(data, 3, 12, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=2, seed=5)
    assert got == pytest.approx(np.array([[weight(i, c) for c in range(3)] for i in range(12)]), abs=1e-9)


def test_labels_against_one_document_at_a_time(docs, model):
    rows = docs.where("doc_id >= 560").collect()
    got = {r["doc_id"]: r for r in language.identify(docs.where("doc_id >= 560"), model).collect()}
    for r in rows:
        found = brute(r["text"])
        x = {b: (1 + math.log(c)) * float(model.idf[b]) for b, c in found.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        logit = [sum(v / norm * float(model.weights[b, c]) for b, v in x.items()) / model.temperature for c in range(len(model.classes))]
        p = [math.exp(v - max(logit)) for v in logit]
        best = max(range(len(p)), key=lambda c: p[c])
        assert got[r["doc_id"]]["language"] == model.classes[best]
        assert got[r["doc_id"]]["confidence"] == pytest.approx(p[best] / sum(p), abs=1e-4)


def test_every_language_has_rows_to_learn_from(spark, docs):
    rare = table(spark, [(10_000 + k, "дом река город вечер " * 3, "ru") for k in range(6)] + [(1, "the and other text", "en")], "doc_id bigint, text string, lang string")
    both = docs.unionByName(rare)
    rows = pick_rows(both, 60, "lang", 5).collect()
    by = Counter(r["label"] for r in rows)
    assert by["ru"] == 5 and sum(by.values()) <= 60 + 4 * 5 and len({r["doc_id"] for r in rows}) == len(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pick_rows(both.repartition(7), 60, "lang", 5).collect()))
    found = language.train(both, sample=60, least=5)
    assert found.classes == ["de", "en", "fr", "ru"]
    assert language.identify(rare, found).where("language = 'ru'").count() == 6


def test_temperature():
    z = np.array([[4.0, 0.0]] * 10)
    t = language.temperature(z, np.array([0] * 8 + [1] * 2))
    assert 1 / (1 + math.exp(-4 / t)) == pytest.approx(0.8, abs=1e-3)
    assert language.temperature(z[:0], np.zeros(0, int)) == 1.0


def test_odd_tables(ugly, nothing, model):
    rows = language.identify(ugly, model).collect()
    assert len(rows) == ugly.count()
    assert all(not r["keep"] and r["language"] is None and r["confidence"] == 0 for r in rows if r["doc_id"] in (3, 4, 5, 7))
    assert all(r["keep"] for r in rows if r["doc_id"] in (1, 2, 6, 8))
    kept = language.keep_identified(ugly, model)
    assert kept.columns == ugly.columns and kept.count() == sum(r["keep"] for r in rows)
    assert language.train(nothing) is None
    assert language.identify(nothing, None).collect() == []
    assert not any(r["keep"] for r in language.identify(ugly, None).collect())
    trained = language.train(ugly)
    assert trained.classes == ["de", "en"]
    assert language.identify(ugly.withColumn("text", F.lit(None).cast("string")), trained).where("keep").count() == 0
