import numpy as np
from pyspark.sql import functions as F

from postlane.functions.tokenizers import from_callable
from postlane.operators import gather
from postlane.operators.index import SearchIndex

TEXTS = [(7, "b a b"), (3, "a"), (9, ""), (5, None), (8, "c b c c")]
POSTINGS = [("a", 3, 1, [0], 1), ("a", 7, 1, [1], 3), ("b", 7, 2, [0, 2], 3), ("b", 8, 1, [1], 4), ("c", 8, 3, [0, 2, 3], 4)]


def rows(index):
    return sorted((r["term"], r["doc_id"], r["tf"], list(r["posns"]), r["doc_len"]) for r in index.postings.collect())


def plan(index):
    return index.postings._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_gathered_in_their_document(spark, tmp_path):
    built = SearchIndex.build(spark.createDataFrame(TEXTS, "doc_id bigint, text string"))
    assert rows(built) == POSTINGS
    assert "MapInArrow" in plan(built) and "Aggregate [term" not in plan(built)  # no row for each word is grouped
    built.save(str(tmp_path))
    assert rows(SearchIndex.load(spark, str(tmp_path))) == POSTINGS


def test_rows_that_share_a_doc_id_are_one_document(spark, tmp_path):
    built = SearchIndex.build(spark.createDataFrame([(1, "a b a"), (1, "b a"), (2, "b")], "doc_id bigint, text string"))
    want = [("a", 1, 3, [0, 1, 2], 3), ("b", 1, 2, [0, 1], 3), ("b", 2, 1, [0], 1)]
    built.save(str(tmp_path))
    assert rows(built) == rows(SearchIndex.load(spark, str(tmp_path))) == want


def test_stretches_hold_no_more_than_they_may():
    sizes = np.array([2, 3, 9, 0, 0, 5, 1])
    assert list(gather.stretches(sizes, 5)) == [(0, 2), (2, 3), (3, 6), (6, 7)]
    assert list(gather.stretches(np.array([], dtype=int), 5)) == []


def test_a_function_of_ones_own_cuts_a_stretch_at_a_time(spark):
    def cut(text):
        class Word(str):
            def __del__(self):
                held[0] -= 1

        held[0] += 1
        return [Word(held[0])]

    held = [0]
    texts = spark.range(0, 200, 1, 1).selectExpr("id AS doc_id", "repeat('x', 65536) AS text")
    words = texts.select(from_callable(cut).column(F.col("text")).alias("w"))
    assert words.selectExpr("max(int(w[0]))", "count(*)").first() == (4, 200)  # not all 200 at once
