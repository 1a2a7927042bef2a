import re

import duckdb
import pytest
from conftest import table

from postlane.llm import line_rules as lr

LINES = {
    "A plain sentence.": True, "So?": True, '"He said so."': True, "Ends (here.)": True, "No end": False, "Home | About | Contact.": False, "One | bar.": True,
    "All Rights Reserved.": False, "Licensed under the Apache License, Version 2.0.": False, "WHAT!! IS!! THIS!!": False, "a*** b### c$$$.": False, "One !! slip in a line of more than ten words all told, here.": True,
    "Wait...": True, "Please accept the cookie notice.": False, "Été.": True, "x = 5;": False,
}


def brute(text, most):
    lines = [x for x in (y.strip(lr.BLANK) for y in (text or "").split("\n")) if x]
    ok = lambda x: bool(re.search(lr.ENDS.replace("\\z", "\\Z"), x)) and not re.search(lr.NAVIGATION, x) and not re.search("|".join(lr.PHRASES), x.lower()) and len(re.findall(lr.CLUTTER, x)) <= len(x.split(" ")) * lr.MOST_CLUTTER
    kept = [x for x in lines if ok(x)]
    total = sum(map(len, lines))
    lost = 1 - sum(map(len, kept)) / total if total else 1.0
    return "\n".join(kept), len(lines), len(kept), round(lost, 6), lost <= most and bool(kept)


@pytest.mark.parametrize("line", LINES)
def test_each_rule(spark, line):
    assert lr.clean_lines(table(spark, [(1, line)])).first()["keep"] == LINES[line]


def test_against_a_scan(spark):
    texts = ["\n".join(list(LINES)[k:j]) for k in range(0, 16, 3) for j in range(k, 16, 2)] + [None, "", " \n ", "A.\n\n  B.  \nmenu", "x" * 40 + "\n" + "y" * 39 + ".", "x" * 39 + "\n" + "y" * 38 + "."]
    texts += ["One.\r\nTwo\r\nThree.\r\n", "\tOne. \t\nno\xa0\n", "One.\xa0\nTwo.", "One.\u2028\nTwo.\x85\nThree.", "| a\u2028b |.\nTwo.", "\r\n\t\r\n"]
    rows = lr.clean_lines(table(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == [brute(t, lr.MOST_LOST) for t in texts]


def test_odd_tables(ugly, nothing):
    rows = lr.clean_lines(ugly).collect()
    assert len(rows) == ugly.count()
    keep = {str(r["doc_id"]): r["keep"] for r in rows if r["n_lines"]}
    assert keep == {"1": True, "2": True, "6": True, "7": True, "8": True, "None": True}
    assert all(r["lost"] == 1 and not r["keep"] and r["clean_text"] == "" for r in rows if r["doc_id"] in (3, 4, 5))
    assert lr.clean_lines(nothing).collect() == []


def test_against_its_sql(spark):
    texts = ["One.\r\nTwo.\r\n", "\tOne. \t\nTwo.\xa0\nIt is three.", "One.\u2028\nTwo.", "| a\u2028b |.\nTwo and three.", "Été.\r", None, "", "\r\n", "A fine line.\nSIGN IN now.", "a*** b### c.\nAnd more words here."]
    rows = list(enumerate(texts))
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = lr.clean_lines(table(spark, rows)).where("keep").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == duck.sql(lr.OP8_SQL + " ORDER BY doc_id").fetchall() and len(got) > 5
