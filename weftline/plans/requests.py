"""Queries over the constant relations and over pages.url, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.url import query_pairs, url_param
from weftline.operators.resolve import resolve_against, resolve_fixed, resolve_random
from weftline.sources import static

#: pages.url has no theme key: its page key and two of its values stand in for them.
KEY, NAMES, DEFAULT = "page", ("2", "3"), "2"
#: Of the drawn fallback.
SEED = 7


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")


def catalog_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.size(F.array(*map(F.lit, static.CATALOG))).alias("n"))


def url_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = pages(spark, sf_dir).select("page_id", F.posexplode(query_pairs(F.col("url"))).alias("pos", "pair"))
    return exploded.select("page_id", "pos", "pair.k", "pair.v")


def url_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", url_param(F.col("url"), KEY).alias("value"))


def resolve_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_fixed(pages(spark, sf_dir), "url", KEY, NAMES, DEFAULT).select("page_id", "valid", "path")


def resolve_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(x,) for x in NAMES], "theme string")
    return resolve_against(pages(spark, sf_dir), "url", KEY, names, DEFAULT).select("page_id", "valid", "path")


def resolve_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_random(pages(spark, sf_dir), "url", KEY, static.CATALOG, seed=SEED, row_key="page_id").select("page_id", "path")


def directory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = static.directory_listing(spark)
    return listing.groupBy("theme", "panel").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def free_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return static.menu_items(spark).filter(F.col("label").contains("бесплатно")).select("theme", "ord")


def _text(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows) + f") AS t({names})"


_DECODE = "url_decode(replace({}, '+', ' '))"
_PARTS = "list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '')"
_PAIRS = f"list_transform({_PARTS}, lambda p: {{'k': {_DECODE.format("split_part(p, '=', 1)")}, 'v': {_DECODE.format("regexp_replace(p, '^[^=]*=?', '')")}}})"
_VALUE = f"list_filter({_PAIRS}, lambda e: e.k = '{KEY}')[1].v"
_MENU = [(t, k, static.MISSPELT[2] if (t, k) == static.MISSPELT[:2] else s, k == 1 and t != static.NO_SELECTION) for t in static.CATALOG for k, s in enumerate(static.SHORT_MENUS.get(t, static.LONG_MENU), 1)]
_LISTING = [(t, p, path if t == "amber-crt.html" else None, n, e, s) for t in ("amber-crt.html", "nc1.html") for p, path, n, e, s in static.LISTING]
_CATALOG = "[" + ", ".join(map(_text, static.CATALOG)) + "]"
_RESOLVED = f"SELECT page_id, coalesce(v IN ('2', '3'), FALSE) AS valid, 'themes/' || CASE WHEN v IN ('2', '3') THEN v ELSE '2' END AS path FROM (SELECT page_id, {_VALUE} AS v FROM pages) AS t"

QUERIES = {
    "theme_catalog": lambda spark, sf_dir: static.theme_catalog(spark),
    "catalog_size": catalog_size,
    "url_pairs": url_pairs,
    "url_param": url_parameter,
    "resolve_valid": resolve_valid,
    "resolve_table": resolve_table,
    "resolve_random": resolve_drawn,
    "directory_listing": lambda spark, sf_dir: static.directory_listing(spark),
    "directory_totals": directory_totals,
    "menu_items": lambda spark, sf_dir: static.menu_items(spark),
    "menu_free": free_items,
    "menu_striped": lambda spark, sf_dir: static.striped_menu(spark),
    "function_keys": lambda spark, sf_dir: static.function_keys(spark),
}

ORACLES = {
    "theme_catalog": _values(list(enumerate(static.CATALOG)), "ord, theme"),
    "catalog_size": "SELECT CAST(count(*) AS INTEGER) AS n FROM (" + _values(list(enumerate(static.CATALOG)), "ord, theme") + ") AS c",
    "url_pairs": f"SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, pair.k AS k, pair.v AS v FROM (SELECT page_id, unnest(pairs) AS pair, generate_subscripts(pairs, 1) AS pos FROM (SELECT page_id, {_PAIRS} AS pairs FROM pages) AS a) AS b",
    "url_param": f"SELECT page_id, {_VALUE} AS value FROM pages",
    "resolve_valid": _RESOLVED,
    "resolve_table": _RESOLVED,
    "resolve_random": f"SELECT page_id, 'themes/' || CASE WHEN list_contains({_CATALOG}, v) THEN v ELSE {_CATALOG}[1 + CAST(floor(CAST('0x' || substr(md5('{SEED}:' || CAST(page_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 * {len(static.CATALOG)}) AS INTEGER)] END AS path FROM (SELECT page_id, {_VALUE} AS v FROM pages) AS t",
    "directory_listing": "SELECT *, DATE '2024-05-24' AS date FROM (" + _values(_LISTING, "theme, panel, path, name, ext, size") + ") AS l",
    "directory_totals": "SELECT theme, panel, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (" + _values(_LISTING, "theme, panel, path, name, ext, size") + ") AS l GROUP BY theme, panel",
    "menu_items": _values(_MENU, "theme, ord, label, selected"),
    "menu_free": "SELECT theme, ord FROM (" + _values(_MENU, "theme, ord, label, selected") + ") AS m WHERE label LIKE '%бесплатно%'",
    "menu_striped": "SELECT * FROM (" + _values(_MENU, "theme, ord, label, selected") + ") AS m WHERE ord % 2 = 0 AND theme = 'ZX_Spectrum_Style_UI.html'",
    "function_keys": _values(list(enumerate(static.FUNCTION_KEYS, 1)), "key, label"),
}
