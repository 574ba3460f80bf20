import pytest
from oracle import assert_same
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline.functions.url import is_member, query_pairs, random_member, url_decoded, url_param
from weftline.operators.resolve import resolve_against, resolve_fixed, resolve_random
from weftline.plans import requests
from weftline.sources import static
from weftline.streaming.resolve import request_stream, write_resolved

SF = "/root/testdata/sf0.001"

CASES = [
    ("?theme=Windows_95.html", "Windows_95.html", True),
    ("?theme=a&theme=b", "a", False),
    ("?theme=", "", False),
    ("?theme", "", False),
    ("?x=1", None, False),
    ("", None, False),
    ("?theme=Windows%5F95.html", "Windows_95.html", True),
    ("?theme=a+b", "a b", False),
    ("?%74heme=nc1.html", "nc1.html", True),
    ("?theme=%zz", "%zz", False),
    ("?Theme=nc1.html", None, False),
    ("?theme=a=b", "a=b", False),
    ("?theme=nc1.html#f", "nc1.html", True),
    ("#a?theme=nc1.html", None, False),
    ("?&&theme=nc1.html", "nc1.html", True),
    ("?theme=%41%zz", "A%zz", False),
    ("?theme=a+%zz", "a %zz", False),
    ("?theme=%FF", "\ufffd", False),
    ("?theme=%", "%", False),
    ("?theme=%4", "%4", False),
    ("?theme=nc1%2ehtml", "nc1.html", True),
    ("?th%65me=nc1%2Ehtml&%zz", "nc1.html", True),
]

#: Components and what a browser reads; the last ones hold bytes that are no UTF-8, of which each longest beginning of a character is one sign.
COMPONENTS = [
    ("", ""),
    ("plain", "plain"),
    ("+%2B+", " + "),
    ("%25%32%35", "%25"),
    ("%%41", "%A"),
    ("%4%31", "%41"),
    ("%g1%1g", "%g1%1g"),
    ("100%", "100%"),
    ("é%C3%A9", "éé"),
    ("%F0%9F%98%80%zz", "😀%zz"),
    ("%00x", "\0x"),
    ("%C3x", "\ufffdx"),
    ("%C3%28", "\ufffd("),
    ("a%FF%FEb", "a\ufffd\ufffdb"),
    ("%F0%9F%98", "\ufffd"),
    ("%E2%82x%AC", "\ufffdx\ufffd"),
]


@pytest.mark.parametrize("name", sorted(requests.ORACLES))
def test_against_sql(spark, name):
    assert_same(requests.QUERIES[name](spark, SF), requests.ORACLES[name], SF)


def test_url_cases(spark):
    df = spark.createDataFrame([(i, "http://h/i.html" + s) for i, (s, _, _) in enumerate(CASES)] + [(99, None)], "i int, url string")
    rows = {r.i: r for r in resolve_fixed(df, "url", "theme", static.CATALOG, "nc1.html").collect()}
    for i, (_, value, valid) in enumerate(CASES):
        assert (rows[i].requested, rows[i].valid) == (value, valid), CASES[i]
        assert rows[i].path == "themes/" + (value if valid else "nc1.html")
    assert rows[99].requested is None and rows[99].path == "themes/nc1.html"
    table = {r.i: r.path for r in resolve_against(df, "url", "theme", static.theme_catalog(spark), "nc1.html").collect()}
    assert table == {i: r.path for i, r in rows.items()}


def test_decoding_of_components(spark):
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(COMPONENTS)] + [(99, None)], "k int, c string").repartition(3)
    decoded = df.select("k", url_decoded(F.col("c")).alias("v"))
    assert {r.k: r.v for r in decoded.collect()} == dict(enumerate(v for _, v in COMPONENTS)) | {99: None}
    plan = decoded._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    pairs = df.select(query_pairs(F.concat(F.lit("http://h/?a="), "c", F.lit("&b="), "c")).alias("p"), "k").filter("k <> 99").collect()
    for r in pairs:
        assert [tuple(e) for e in r.p] == [(n, COMPONENTS[r.k][1]) for n in "ab"]


def test_long_values(spark):
    long = "%41" * 100_000 + "%zz+"
    df = spark.createDataFrame([("http://h/?theme=" + long,)], "url string")
    assert df.select(url_param(F.col("url"), "theme").alias("v")).first().v == "A" * 100_000 + "%zz "


def test_sql_decodes_as_well(spark, tmp_path):
    urls = ["http://h/?page=2", "http://h/?p%61ge=%32&x=a+b%20c", "http://h/?page", "http://h/?page=&page=2", "http://h/#?page=2", "http://h/", "http://h/?page=%zz", "http://h/?page=3%2b+%C3%A9"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "t"))
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    for name in ("url_pairs", "url_param", "resolve_valid", "resolve_table", "resolve_random"):
        assert_same(requests.QUERIES[name](spark, str(tmp_path)), requests.ORACLES[name], str(tmp_path))


def test_a_keyed_draw_repeats_whatever_the_partitions(spark):
    df = spark.range(16000).select(F.col("id"), F.lit("http://h/").alias("url"))
    draw = lambda d, seed: {r.id: r.path for r in resolve_random(d, "url", "theme", static.CATALOG, seed, row_key="id").collect()}
    one = draw(df.repartition(2), 3)
    assert one == draw(df.repartition(7, "id"), 3) != draw(df, 4)
    counts = {p: sum(x == p for x in one.values()) for p in set(one.values())}
    assert len(counts) == 16 and all(850 < n < 1150 for n in counts.values())
    nulls = spark.createDataFrame([(None,), (None,)], "id long").withColumn("url", F.lit("http://h/"))
    assert len({r.path for r in resolve_random(nulls, "url", "theme", static.CATALOG, 3, row_key="id").collect()}) == 1


def test_repeated_keys_stay_in_order(spark):
    df = spark.createDataFrame([("http://h/?a=1&b&a=2",)], "url string")
    assert [tuple(e) for e in df.select(query_pairs(F.col("url")).alias("p")).first().p] == [("a", "1"), ("b", ""), ("a", "2")]
    assert df.select(url_param(F.col("url"), "a").alias("v")).first().v == "1"


def test_random_fallback_is_a_member_and_even(spark):
    df = spark.range(16000).select(F.lit("http://h/").alias("url"))
    counts = {r.path: r["count"] for r in resolve_random(df, "url", "theme", static.CATALOG, seed=3).groupBy("path").count().collect()}
    assert set(counts) == {"themes/" + x for x in static.CATALOG}
    assert all(800 < n < 1200 for n in counts.values())


def test_membership_of_null_and_of_an_empty_list(spark):
    row = spark.range(1).select(is_member(F.lit(None).cast("string"), ("a",)).alias("x"), is_member(F.lit("a"), ()).alias("y"), random_member(["z"]).alias("z")).first()
    assert tuple(row) == (False, False, "z")


def test_counts(spark):
    menu = static.menu_items(spark)
    assert (menu.count(), menu.filter("selected").count(), requests.free_items(spark, SF).count()) == (128, 15, 28)
    assert {(r.panel, r.bytes) for r in requests.directory_totals(spark, SF).collect()} == {("left", 13480), ("right", 45)}


def test_stream_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    table = spark.read.parquet(f"{SF}/pages.parquet")
    table.repartition(4).write.parquet(src)
    query = write_resolved(request_stream(spark, src, 1), "page", ("2", "3"), "2", out, str(tmp_path / "state"))
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, requests.resolve_valid(spark, SF).select("page_id", "path").collect()))


def test_no_shuffle_in_validation(spark):
    plan = requests.resolve_valid(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
