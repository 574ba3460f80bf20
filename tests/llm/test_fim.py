import hashlib
import re
from collections import Counter

import pytest
from oracle import assert_same

from weftline.llm import fim, queries

SF = "/root/testdata/sf0.001"


def brute(doc_id, text, seed=1, cut=90, first=20):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut:
        return doc_id, n, "plain", t, None, None
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if h[3] % 100 < first:
        return doc_id, n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return doc_id, n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


ODD = ["", None, " ", "a", "ab cd", "a\nb\r\n\tc\0d", "é日本 abc😀z", "x<P>y", "a<S", "<M>", "<", "a < P > b", "<<<P", ">S><", "é ​", "a" * 50_000 + " b" * 200_000, "日" * 300_000]


def test_rows_equal_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(ODD * 12)] + [(None, "some words here"), (None, "some words here"), (7, "twice the id"), (7, "twice the id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, fim.fill_in_middle(df).collect())) == Counter(brute(*r) for r in rows)
    got = fim.fill_in_middle(df, seed=9, cut_percent=50, suffix_first_percent=70).collect()
    assert Counter(map(tuple, got)) == Counter(brute(*r, 9, 50, 70) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_texts_come_back(spark):
    rows = [(k, t) for k, t in enumerate(ODD * 20)]
    made = fim.digests(fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")))
    want = {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t in rows}
    assert {r.doc_id: r.restored_sha256 for r in made.collect()} == want


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_against_sql(spark, sf):
    assert_same(queries.op11_fill_in_middle(spark, sf), fim.SQL, sf)


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "one two", "x", 5, "y")], "doc_id long, text string, form string, n int, output string")
    assert [tuple(r) for r in fim.fill_in_middle(df).collect()] == [brute(1, "one two")]
    assert fim.digests(fim.fill_in_middle(df.limit(0))).count() == 0


def test_no_shuffle(spark):
    plan = queries.op11_fill_in_middle(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
