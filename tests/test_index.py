import random

import pytest
from pyspark.sql import functions as F

from postlane.functions import similarity as sim
from postlane.functions.tokenizers import lowercase
from postlane.operators import documents as docs_ops
from postlane.operators.index import SearchIndex, TermMissingError
from postlane.operators.results import Results, top

BASE = ["foo bar bar baz", "data2", "data3 bar", "bunny funny wunny"] * 25


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.fixture(scope="module")
def base(spark):
    return SearchIndex.build(table(spark, BASE))


def column(df, name):
    return [r[name] for r in df.orderBy("doc_id").collect()]


def test_term_statistics(base):
    assert column(base.termfreqs("bar"), "tf") == [2, 0, 1, 0] * 25
    assert [base.docfreq(t).first()["df"] for t in ("bar", "foo", "none")] == [50, 25, 0]
    assert tuple(base.stats.first()) == (100, 2.5)
    assert sum(column(base.termfreqs("none"), "tf")) == 0


def test_bm25_known_values(base):
    assert column(base.score("bar"), "score")[:4] == pytest.approx([0.37066694, 0, 0.34314217, 0], abs=1e-7)


@pytest.mark.parametrize(("tf", "df", "dl", "avgdl", "n", "score"), [(2, 14, 4, 2.7322686, 8516, 3.52482), (1, 5, 35, 50.580456, 8514, 3.8199246), (2, 7, 44, 50.580456, 8514, 4.5636616), (25, 7823, 152, 119.18542, 8516, 0.08028283)])
def test_bm25_of_given_statistics(spark, tf, df, dl, avgdl, n, score):
    one = spark.createDataFrame([(tf, df, dl, avgdl, n)], "tf int, df bigint, dl int, avgdl double, n bigint")
    c = F.col
    assert one.select(sim.bm25()(c("tf"), [c("df")], c("dl"), c("avgdl"), c("n"))).first()[0] == pytest.approx(score, rel=1e-5)


def test_similarities_relate(base):
    plain, legacy, impact = (column(base.score("bar", s), "score") for s in (sim.bm25(), sim.bm25_legacy(), sim.bm25_impact()))
    assert legacy == pytest.approx([2.2 * x for x in plain])
    assert impact[0] == pytest.approx(2 / (2 + 1.2 * (0.25 + 0.75 * 4 / 2.5)))
    own = sim.from_callable(lambda tf, dfs, dl, avgdl, n: tf * 0 + dfs[0] + n)
    assert column(base.score("bar", own), "score")[:2] == [150.0, 0.0]
    assert all(x >= 0 for x in column(base.score("bar", sim.classic()), "score"))


@pytest.mark.parametrize(
    ("text", "phrase", "tf"),
    [
        ("foo bar foo bar", ["foo", "bar"], 2),
        ("foo bar foo", ["foo", "bar", "foo"], 1),
        ("foo bar foo bar foo", ["foo", "bar", "foo"], 2),
        ("foo foo", ["foo", "foo"], 1),
        ("foo foo foo", ["foo", "foo"], 1),
        ("foo foo foo foo", ["foo", "foo"], 2),
        ("foo foo foo foo baz foo foo", ["foo", "foo"], 3),
        ("foo foo foo foo", ["foo", "foo", "foo", "foo"], 1),
        ("foo bar bar baz foo bar bar", ["foo", "bar", "bar"], 2),
        ("bar foo", ["foo", "bar"], 0),
        ("foo", ["foo", "none"], 0),
    ],
)
def test_phrases(spark, text, phrase, tf):
    index = SearchIndex.build(table(spark, [text, "", None, text]))
    assert column(index.termfreqs(phrase), "tf") == [tf, 0, 0, tf]


def test_phrases_at_every_offset(spark):
    texts = [" ".join(["pad"] * k + ["to", "be", "or"] + ["gap"] * k + ["to", "be", "or"]) for k in range(100)]
    index = SearchIndex.build(table(spark, texts))
    assert column(index.termfreqs(["to", "be", "or"]), "tf") == [2] * 100
    assert column(index.termfreqs(["to", "or"]), "tf") == [0] * 100


def test_random_phrases_against_a_scan(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(40)]
    index = SearchIndex.build(table(spark, texts))
    for phrase in (["a", "b"], ["a", "b", "c"], ["c", "b", "c", "a"]):
        naive = [sum(t.split()[k : k + len(phrase)] == phrase for k in range(len(t.split()))) for t in texts]
        assert column(index.termfreqs(phrase), "tf") == naive
    both, wide = (column(index.termfreqs(["a", "b", "c"], slop=s), "tf") for s in (1, 4))
    exact = column(index.termfreqs(["a", "b", "c"]), "tf")
    assert all(a <= b <= c for a, b, c in zip(exact, both, wide))


SEA = "A small boat leaves the harbour in fog while two sailors argue about the chart that one of them found"


@pytest.mark.parametrize(("phrase", "slop", "found"), [("small boat leaves", 0, True), ("small leaves boat", 0, False), ("small leaves boat", 1, True), ("boat harbour fog", 2, False), ("boat harbour fog", 3, True), ("the the", 7, False), ("no such words here", 5, False)])
def test_slop(spark, phrase, slop, found):
    index = SearchIndex.build(table(spark, [SEA, " nothing ", SEA + " " + SEA]))
    scores = column(index.score(phrase.split(), slop=slop), "score")
    assert (scores[0] > 0) == found and scores[1] == 0


def test_one_case_that_differs_on_purpose(spark):
    """Three of the same word that no window of n - 1 + slop words holds aren't a match, however near an approximate search may find them."""
    text = " ".join(["the" if k in (22, 37, 43) else f"w{k}" for k in range(60)])
    index = SearchIndex.build(table(spark, [text]))
    assert column(index.termfreqs(["the"] * 3, slop=9), "tf") == [0]
    assert column(index.termfreqs(["the"] * 3, slop=19), "tf") == [1]


def test_bounds_of_places(spark):
    text = "foo bar bar baz" + " ".join(["boz"] * 25) + " foo bar"
    index = SearchIndex.build(table(spark, [text, "data2"]))
    for low, high, tf in ((0, 17, 1), (0, None, 2), (18, None, 1), (None, None, 2)):
        assert column(index.termfreqs(["foo", "bar"], min_posn=low, max_posn=high), "tf") == [tf, 0]
    for low, high in ((1, None), (0, 16)):
        with pytest.raises(ValueError):
            index.termfreqs("foo", min_posn=low, max_posn=high)


def test_arguments(base, spark):
    for token in (("foo", "bar"), 3, ["foo", 3]):
        with pytest.raises(TypeError):
            base.termfreqs(token)
    with pytest.raises(ValueError):
        base.termfreqs([])
    with pytest.raises(TypeError):
        base.docfreq(3)
    with pytest.raises(TypeError):
        SearchIndex.build(["a"])
    with pytest.raises(TermMissingError):
        base.positions("none", check=True)


def test_long_documents(spark, tmp_path):
    df = table(spark, ["a b c d e f", "a b"])
    with pytest.raises(Exception, match="more words"):
        SearchIndex.build(df, max_places=4).termfreqs("a").collect()
    with pytest.raises(Exception, match="more words"):
        SearchIndex.build(df, max_places=4).save(str(tmp_path / "x"))
    cut = SearchIndex.build(df, max_places=4, truncate=True)
    assert column(cut.docs, "doc_len") == [4, 2]
    assert column(cut.termfreqs("e"), "tf") == [0, 0]


def test_empty_tables(spark):
    index = SearchIndex.build(spark.createDataFrame([], "doc_id bigint, text string"))
    assert index.score("a").collect() == []
    assert tuple(index.stats.first()) == (0, 0.0)
    blank = SearchIndex.build(table(spark, ["", "", None]))
    assert column(blank.score("a"), "score") == [0.0] * 3
    assert column(docs_ops.is_missing(blank), "missing") == [True] * 3


def test_save_load_union_upsert(spark, tmp_path):
    first = SearchIndex.build(table(spark, ["A b", "b c"]), tokenizer=lowercase)
    first.save(str(tmp_path / "x"))
    again = SearchIndex.load(spark, str(tmp_path / "x"))
    assert again.tokenizer is lowercase
    assert column(again.score("b"), "score") == column(first.score("b"), "score")
    other = SearchIndex.build(spark.createDataFrame([(1, "z z"), (2, "b")], "doc_id bigint, text string"), tokenizer=lowercase)
    merged = again.upsert(other)
    assert column(merged.termfreqs("b"), "tf") == [1, 0, 1]
    assert merged.stats.first()["n_docs"] == 3


def test_a_filtered_index_counts_its_own_documents(base):
    some = base.filter(F.col("doc_id") % 2 == 0)
    assert some.docfreq("bar").first()["df"] == 50
    one = base.filter(F.col("doc_id") == 0)
    assert one.docfreq("bar").first()["df"] == 1
    assert one.stats.first()["n_docs"] == 100


def test_positions(base):
    rows = base.positions("bar").orderBy("doc_id").limit(3).collect()
    assert [list(r["posns"]) for r in rows] == [[1, 2], [], [1]]


def test_from_counts(spark):
    df = spark.createDataFrame([(0, {"a": 3, "b": 1}), (1, None)], "doc_id bigint, counts map<string,int>")
    index = SearchIndex.from_counts(df)
    assert column(index.termfreqs("a"), "tf") == [3, 0]
    assert column(index.docs, "doc_len") == [2, 0]


def test_documents_as_rows(spark):
    index = SearchIndex.build(table(spark, ["a b", "b a", "a a b", "", "c"]))
    counts = {(tuple(r["terms"]), r["doc_len"]): r["n"] for r in docs_ops.value_counts(index).collect()}
    assert counts == {(("a", "b"), 2): 2, (("a", "b"), 3): 1, (("c",), 1): 1}
    assert column(docs_ops.factorize(index), "code") == [0, 0, 2, -1, 4]
    ranks = column(docs_ops.sort_documents(index), "rank")
    assert ranks == [3, 4, 5, 1, 2]  # nothing, c alone, then a once, a twice
    assert column(docs_ops.equal(index, SearchIndex.build(table(spark, ["b a", "b", "a b a", "", "c"]))), "equal") == [True, False, True, True, True]
    wanted = spark.createDataFrame([(0, 4), (1, 0), (2, -1)], "ord bigint, doc_id bigint")
    assert [list(r["terms"]) for r in docs_ops.take(index, wanted).orderBy("ord").collect()] == [["c"], ["a", "b"], []]
    with pytest.raises(IndexError):
        docs_ops.document(index, 99)


def near(places, need, width):
    """Disjoint windows, earliest end first, that hold a place of its own for each term."""
    held, n = {t: [] for t in need}, 0
    for p, t in sorted((p, t) for t in need for p in places[t]):
        held[t].append(p)
        if all(len(held[t]) >= k for t, k in need.items()) and p - min(held[t][-k] for t, k in need.items()) <= width:
            held, n = {t: [] for t in need}, n + 1
    return n


def test_slop_frequencies_against_a_scan(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 80))) for _ in range(50)]
    index = SearchIndex.build(table(spark, texts))
    for phrase in (["c", "a", "b"], ["a", "b", "a"], ["a", "a"]):
        need = {t: phrase.count(t) for t in phrase}
        exact = column(index.termfreqs(phrase), "tf")
        for slop in (1, 6):
            want = [near({t: [k for k, w in enumerate(x.split()) if w == t] for t in need}, need, len(phrase) - 1 + slop) for x in texts]
            want = [max(w, e) if all(t in x.split() for t in need) else 0 for w, e, x in zip(want, exact, texts)]
            assert column(index.termfreqs(phrase, slop=slop), "tf") == want


@pytest.fixture(scope="module")
def random_texts(spark, tmp_path_factory):
    r = random.Random(8)
    texts = [" ".join(r.choice("abbccccdddddddd") for _ in range(r.randint(0, 30))) for _ in range(60)] + ["rare a b", ""]
    lazy = SearchIndex.build(table(spark, texts))
    path = str(tmp_path_factory.mktemp("saved"))
    lazy.save(path)
    return texts, lazy, SearchIndex.load(spark, path)


@pytest.mark.parametrize("most", [0, 8 << 20])
def test_saved_and_lazy_indexes_agree(random_texts, monkeypatch, most):
    """With everything small enough to be broadcast, and with nothing."""
    monkeypatch.setattr("postlane.operators.index.BROADCAST_BYTES", most)
    _, lazy, saved = random_texts
    cases = [("a", {}), ("none", {}), ("d", {"min_posn": 18}), (["rare", "a", "b"], {}), (["d", "c", "d"], {"min_posn": 18}), (["b", "none"], {}), (["d", "d"], {}), (["c", "d", "b"], {"slop": 2})]
    for token, how in cases:
        a, b = (x.score(token, **how).join(x.termfreqs(token, **how), "doc_id").orderBy("doc_id").collect() for x in (lazy, saved))
        assert a == b
    for term in ("c", "none"):
        assert column(saved.positions(term), "posns") == column(lazy.positions(term), "posns")
    chosen = F.col("doc_id") % 3 == 1
    assert column(saved.filter(chosen).score(["c", "d"]), "score") == column(lazy.filter(chosen).score(["c", "d"]), "score")


def test_the_best_are_those_of_all_scores(random_texts):
    _, lazy, saved = random_texts
    falling = lambda tf, dfs, dl, avgdl, n: F.lit(5.0) - tf
    for token, similarity, n in (("d", sim.bm25(), 1), ("rare", sim.bm25(), 5), ("none", sim.bm25(), 2), (["c", "d"], sim.bm25(), 100), ("d", falling, 40), ("a", sim.classic(), 3)):
        want = top(lazy.score(token, similarity), n).collect()
        assert saved.top(token, n, similarity).collect() == want
    assert lazy.top("rare", 5).collect() == top(lazy.score("rare"), 5).collect()


def test_saved_counts_and_sizes(random_texts):
    texts, lazy, saved = random_texts
    as_set = lambda df: sorted(map(tuple, df.collect()))
    assert as_set(saved.term_stats()) == as_set(lazy.term_stats())
    assert as_set(saved.top_terms(3)) == as_set(lazy.top_terms(3))
    assert [x.docfreq(t).first()["df"] for x in (lazy, saved) for t in ("d", "none")] == [sum("d" in t.split() for t in texts), 0] * 2
    bags = [t.split() for t in texts]
    want = sum(8 * len(set(b)) + 4 * len(b) + 4 for b in bags)
    assert saved.memory_usage().first()[0] == lazy.memory_usage().first()[0] == want
    assert len(saved) == len(texts)


def test_one_document_and_all(random_texts):
    texts, lazy, saved = random_texts
    counts = SearchIndex.from_counts(lazy.docs.sparkSession.createDataFrame([(0, {"a": 3, "b": 1}), (1, None), (2, {"b": 1, "a": 3})], "doc_id bigint, counts map<string,int>"))
    for index in (lazy, saved):
        one = docs_ops.Terms.of(index, 0)
        words = texts[0].split()
        assert dict(one.terms()) == {t: words.count(t) for t in words} and one.doc_len == len(words) and len(one) == len(set(words))
        assert one.positions("d") == [k for k, w in enumerate(words) if w == "d"] and one.termfreq("d") == words.count("d")
        numbers = {t: k for k, t in enumerate("abcd")}
        assert one.tf_to_dense(numbers) == [words.count(t) for t in "abcd"]
        assert one.raw_positions(numbers, "d") == [(3, one.positions("d"))] and len(one.raw_positions(numbers)) == len(one)
        assert {r["doc_id"]: list(r["terms"]) for r in docs_ops.each(index)} == {k: sorted(set(t.split())) for k, t in enumerate(texts)}
        assert {(tuple(r["terms"]), r["doc_len"]) for r in docs_ops.unique(index).collect()} == {(tuple(sorted(set(t.split()))), len(t.split())) for t in texts}
    assert column(docs_ops.factorize(counts), "code") == [0, -1, 0]
    assert column(docs_ops.sort_documents(counts), "rank") == [2, 1, 3]


def test_boolean_queries_and_results(spark, base):
    assert column(base.all_of(["foo", "bar"]), "doc_id") == list(range(0, 100, 4))
    assert len(base.at_least(["foo", "data3", "funny"], 1).collect()) == 75
    assert [r["doc_id"] for r in top(base.score("bar"), 3).collect()] == [0, 4, 8]
    found = Results(2)
    with pytest.raises(ValueError):
        found.all()
    found.insert(base.score("bar"), "bar")
    found.search(base, "data2", "data2")
    assert [(r["query"], r["rank"], r["doc_id"]) for r in found.all().collect()] == [("bar", 1, 0), ("bar", 2, 4), ("data2", 1, 1), ("data2", 2, 5)]
