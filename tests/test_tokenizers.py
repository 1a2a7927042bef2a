import pytest
from pyspark.sql import functions as F

from postlane.functions import tokenizers as tok

TEXTS = ["The cat's  hat.\nSat", "", "  ", None, "a　b c\x1cd\x85e", "—... “Quoted” – dash-ed", "ÉTÉ Été"]


@pytest.mark.parametrize("name", [*tok.NAMED, "own"])
def test_columns_and_queries_agree(spark, name):
    t = tok.from_callable(lambda x: x.upper().split("a")) if name == "own" else tok.NAMED[name]
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string").select("k", t.column(F.col("text")).alias("t")).collect()
    for k, words in rows:
        assert words == t(TEXTS[k]), TEXTS[k]


def test_empty_words_and_folding():
    assert tok.stripped("A -- b!") == ["a", "", "b"]
    assert tok.folded("it's “so”") == ["it", "s", '"so"']
    with pytest.raises(ValueError):
        tok.whitespace(3)
