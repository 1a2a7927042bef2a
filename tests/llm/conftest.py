import random

import pytest

#: Columns that operators make for themselves, as further columns of the input.
CLASHING = "keep string, score string, language string, hi string, f string, lines string, kept string, words string, turn string, copies string, bin_id string, w0 string, preferred string, begin string, `end` string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"
LONG = "Ein sehr langer Satz mit vielen Wörtern steht hier. " * 20_000


def prose(r, n, words=("the", "river", "and", "stone", "of", "market", "walked", "slowly", "under", "bridge", "lantern", "quiet", "harbour", "toward", "evening")):
    return " ".join(r.choice(words) + r.choice(("", "", "", str(r.randint(0, 999)), "ing")) for _ in range(n))


def table(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def ugly(spark):
    """Nulls everywhere, empty, blank and very long texts, rows that repeat, columns with clashing names."""
    r = random.Random(1)
    text = prose(r, 80) + "."
    more = ["x"] * 15
    rows = [
        (1, text, "en", "a", 5, *more), (1, text, "en", "a", 5, *more), (2, text, "en", "b", None, *more),
        (3, None, "en", "a", 0, *more), (4, "", "de", None, 0, *more), (5, " \n\t ", None, "b", 4, *more), (6, LONG, "de", "a", len(LONG), *more),
        (None, text, "en", "a", 5, *more), (None, None, None, None, None, *[None] * 15), (7, "...", "en", "b", 3, *more), (8, prose(r, 70) + ".", "en", "b", 9, *more),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
