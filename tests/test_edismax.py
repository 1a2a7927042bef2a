import pytest

from postlane.functions import similarity as sim
from postlane.functions.tokenizers import constant, keyword
from postlane.operators.edismax import edismax
from postlane.operators.index import SearchIndex

TITLE = ["foo bar bar baz", "data2", "data3 bar", "bunny funny wunny"]
BODY = ["buzz", "data2", "foo bar", "bar"]


@pytest.fixture(scope="module")
def fields(spark):
    build = lambda texts, t=None: SearchIndex.build(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), tokenizer=t)
    return {"title": build(TITLE), "body": build(BODY), "whole": build(TITLE, keyword), "bees": build(BODY, constant)}


def of(df):
    return [r["score"] for r in df.orderBy("doc_id").collect()]


def scores(index, token, **more):
    return of(index.score(token, **more))


def test_term_centric_takes_the_best_field_of_each_term(fields):
    got, explain = edismax(fields, q="foo bar", qf=["title", "body"])
    t, b = fields["title"], fields["body"]
    want = [sum(max(x) for x in ((f1, f2), (g1, g2))) for f1, f2, g1, g2 in zip(scores(t, "foo"), scores(b, "foo"), scores(t, "bar"), scores(b, "bar"))]
    assert of(got) == pytest.approx(want)
    assert explain == "((title:foo^1 | body:foo^1) (title:bar^1 | body:bar^1))~1"


def test_boosts_ties_and_minimum(fields):
    t, b = scores(fields["title"], "bar"), scores(fields["body"], "bar")
    got, explain = edismax(fields, q="bar", qf=["title^10", "body"], tie=0.5)
    assert of(got) == pytest.approx([max(10 * x, y) + 0.5 * min(10 * x, y) for x, y in zip(t, b)])
    assert explain == "((title:bar^10.0 | body:bar^1))~1"
    both = of(edismax(fields, q="foo bar", qf=["title", "body"], mm="100%")[0])
    assert [x > 0 for x in both] == [True, False, True, False]
    assert of(edismax(fields, q="foo bar", qf=["title", "body"], q_op="AND", mm=1)[0]) == pytest.approx(both)


def test_field_centric_where_fields_cut_the_query_differently(fields):
    got, explain = edismax(fields, q="foo bar bar baz", qf=["whole^2", "title"], mm=3)
    title = [sum(x) if sum(v > 0 for v in x) >= 3 else 0 for x in zip(*(scores(fields["title"], w) for w in "foo bar bar baz".split()))]
    whole = scores(fields["whole"], "foo bar bar baz")
    assert of(got) == pytest.approx([max(2 * a, b) for a, b in zip(whole, title)])
    assert explain == "((whole:foo bar bar baz)~1)^2.0 | ((title:foo title:bar title:bar title:baz)~3)^1"


def test_a_word_that_repeats_counts_twice(fields):
    assert of(edismax(fields, q="bar bar", qf="title")[0]) == pytest.approx([2 * x for x in scores(fields["title"], "bar")])


def test_phrases_add_to_what_matches(fields):
    base = of(edismax(fields, q="foo bar", qf="title")[0])
    some = fields["title"].filter(edismax(fields, q="foo bar", qf="title")[0].where("score > 0"))
    phrase = {r["doc_id"]: r["score"] for r in some.score(["foo", "bar"]).collect()}
    with_pf, explain = edismax(fields, q="foo bar", qf="title", pf="title^3")
    assert of(with_pf) == pytest.approx([x + 3 * phrase.get(k, 0) for k, x in enumerate(base)])
    assert explain.endswith(' (title:"foo bar")^3.0')
    pairs = of(edismax(fields, q="foo bar", qf="title", pf2=["title"])[0])
    assert pairs == pytest.approx([x + 2 * phrase.get(k, 0) for k, x in enumerate(base)])  # the last pair counts twice
    assert of(edismax(fields, q="foo bar", qf="title", pf3="title")[0]) == pytest.approx(base)
    assert of(edismax(fields, q="foo bar bar", qf="title", pf3="title")[0]) != pytest.approx(of(edismax(fields, q="foo bar bar", qf="title")[0]))
    assert of(edismax(fields, q="foo bar", qf="title", pf="title^3", ps=5)[0]) == pytest.approx(of(with_pf))


def test_own_similarities(fields):
    one = sim.from_callable(lambda tf, dfs, dl, avgdl, n: (tf > 0).astype(float))
    assert of(edismax(fields, q="foo bar", qf=["title", "body"], similarity=one)[0]) == [2.0, 0.0, 2.0, 1.0]
    tiny = lambda tf, dfs, dl, avgdl, n: (tf > 0).cast("double") * 0.0001
    got = of(edismax(fields, q="foo bar", qf=["title", "body"], similarity={"title": one, "body": tiny})[0])
    assert got == pytest.approx([2.0, 0.0, 1.0001, 0.0001])


def test_tokenizers_are_used_on_queries(fields):
    assert of(edismax(fields, q="anything", qf="bees")[0]) == pytest.approx(scores(fields["bees"], "b"))


def test_odd_queries(fields):
    assert of(edismax(fields, q="", qf=["title", "body"])[0]) == [0.0] * 4
    assert of(edismax(fields, q="none", qf=["title", "body"])[0]) == [0.0] * 4
    with pytest.raises(ValueError):
        edismax(fields, q="foo", qf="title", pf="body")
    with pytest.raises(ValueError):
        edismax(fields, q="foo", qf="missing")
