from postlane.functions.tokenizers import keyword, whitespace
from postlane.operators.edismax import read_query
from postlane.plans import queries


def test_a_query_is_read_by_tokenizers_alone():
    read = read_query({"a": whitespace, "b": whitespace, "c": keyword}, "x y", ["a^2", "b"], pf2=["b"])
    assert read.explain == '((a:x^2.0 | b:x^1) (a:y^2.0 | b:y^1))~1 (b:"x y")^1'
    assert read.phrases == {"b": [(["x", "y"], 1.0)] * 2}
    assert not read_query({"a": whitespace, "c": keyword}, "x y", ["a", "c"]).term_centric


def test_no_index_is_built_to_read_queries(spark, monkeypatch):
    monkeypatch.setattr(queries, "index", lambda *_: 1 / 0)
    assert queries.QUERIES["edismax_explained"](spark, "/no/such/folder").count() == len(queries.EDISMAX)
