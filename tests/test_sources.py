import gzip
import io
import json

import pytest

from postlane.operators import sets
from postlane.operators.index import SearchIndex
from postlane.sources import readers
from postlane.streaming import append


def test_tsv(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('1\thttp://a\t"quoted\tbody text\n2\thttp://b\tt\t\n')
    rows = readers.tsv(spark, str(tmp_path / "x.tsv"), ["doc_id", "url", "title", "body"]).orderBy("doc_id").collect()
    assert rows[0]["title"] == '"quoted' and rows[0]["body"] == "body text"


def test_json_map(spark, tmp_path):
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        json.dump({"5": {"title": "a"}, "6": {"title": "b", "overview": "c"}}, f)
    rows = readers.json_map(spark, str(tmp_path / "x.json.gz"), ["title", "overview"]).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [("5", "a", ""), ("6", "b", "c")]


def test_json_members_over_every_cut(monkeypatch):
    record = {"a": {"t": "x\u00e9\u4e2d}{\\\" ", "n": [1, 2.5, None]}, "": {}, "b": 12345, "c": "s"}
    for text in (json.dumps(record), json.dumps(record, ensure_ascii=False, indent=2), "{}", " { } "):
        for size in (1, 2, 7, 1000):
            monkeypatch.setattr(readers, "_READ", size)
            assert list(readers.members(io.BytesIO(text.encode()))) == list(json.loads(text).items())
    for bad in ("", "[1]", '{"a": 1', '{"a" 1}'):
        with pytest.raises(ValueError):
            list(readers.members(io.BytesIO(bad.encode())))


def test_a_stream_adds_to_an_index(spark, tmp_path):
    spark.createDataFrame([(0, "a b"), (1, "b")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    for extra in ([], [(2, "a a"), (1, "a b b")]):
        if extra:
            spark.createDataFrame(extra, "doc_id bigint, text string").write.mode("append").parquet(str(tmp_path / "in"))
        docs = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
        run = append.append_stream(docs, str(tmp_path / "index"), str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        run.awaitTermination(60)
    index = append.load(spark, str(tmp_path / "index"))
    whole = append.compact(spark, str(tmp_path / "index"), str(tmp_path / "whole"))
    for x in (index, whole, SearchIndex.load(spark, str(tmp_path / "whole"))):
        assert [r["tf"] for r in x.termfreqs("a").orderBy("doc_id").collect()] == [1, 1, 2]
        assert [r["tf"] for r in x.termfreqs("b").orderBy("doc_id").collect()] == [1, 2, 0]
        assert tuple(x.stats.first()) == (3, 7 / 3) and len(x) == 3


def test_sets(spark):
    a = spark.createDataFrame([(1, 4), (1, 7), (2, 1)], "k int, v int")
    b = spark.createDataFrame([(1, 5), (3, 2)], "k int, v int")
    assert [r["k"] for r in sets.intersect(a, b, "k").collect()] == [1]
    assert len(sets.rows_in(a, b, "k").collect()) == 2
    assert [tuple(r) for r in sets.adjacent(a, b, "k", "v").collect()] == [(1, 4)]
    assert len(sets.merge(a, a, distinct=True).collect()) == 3
    assert {tuple(r) for r in sets.merge_counts(a, b, "k", "v").collect()} == {(1, 16), (2, 1), (3, 2)}
