import os

import pytest
from conftest import prose, table
from pyspark.sql import functions as F
import random

import corpus_pipeline as cp

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(12)
    text = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(90)) + "."
    rows = [(k, text(), "en", "hot" if k < 60 else f"s{k % 3}") for k in range(100)]
    rows += [(100, rows[3][1], "en", "s1"), (101, rows[4][1].replace(".", "!") + " more", "en", "s1"), (102, "", "en", "s1"), (103, None, None, None), (104, "... 12 !!", "en", "s0")]
    rows.append((105, rows[5][1][::-1] + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + text(), "en", "s2"))
    return table(spark, [(*x, len(x[1] or "")) for x in rows], SCHEMA)


def test_each_stage_by_what_it_must_do(spark, docs):
    stage = dict(cp.STAGES)
    one = stage["language_id"](spark, docs, "").persist()
    assert {r["doc_id"] for r in one.collect()} == set(range(106)) - {102, 103, 104}
    two = stage["near_dedup"](spark, one, "").persist()
    assert {r["doc_id"] for r in two.collect()} == {*range(100), 105}
    three = stage["secret_scan"](spark, two, "").persist()
    changed = {r["doc_id"]: r for r in three.exceptAll(two).collect()}
    assert list(changed) == [105] and "04dbebab" not in changed[105]["text"] and "[SECRET]" in changed[105]["text"] and changed[105]["n_chars"] == len(changed[105]["text"])
    four = stage["source_mixing"](spark, three, "").persist()
    assert four.columns == docs.columns
    assert {r["doc_id"] for r in four.collect()} == {r["doc_id"] for r in three.collect()} and four.count() > three.count()
    assert four.where("source = 'hot'").count() == 60
    packed = stage["packing"](spark, four, "").collect()
    words = four.select(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0]
    assert sum(r["words"] for r in packed) == words


def test_nothing_in_nothing_out(spark, docs):
    out = docs.where("false")
    for _, stage in cp.STAGES:
        out = stage(spark, out, "")
        assert out.collect() == []


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables aren't there")
def test_the_whole_run(spark):
    rows = cp.run(spark, SMALL).collect()
    loads = {}
    for r in rows:
        loads[r["bin_id"]] = loads.get(r["bin_id"], 0) + r["words"]
    assert rows and max(loads.values()) <= 2048
    assert len({r["doc_id"] for r in rows}) > 150


def test_texts_go_to_python_in_small_batches(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("10000", cp.BATCH), ("0", cp.BATCH), ("50", 50)):
            for stage, run in cp.STAGES[2:3]:
                spark.conf.set(name, given)
                run(spark, docs, "")
                assert int(spark.conf.get(name)) == want, stage
    finally:
        spark.conf.set(name, before)
