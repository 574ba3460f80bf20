"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import broadcast_if_small, saved

#: A mean above this is drawn as a sum of draws with smaller means, which is the same distribution.
DRAW_MEAN = 32.0
#: Terms of a draw's distribution; those beyond it have a chance under 1e-40 at DRAW_MEAN.
TERMS = 160
#: Source names up to which the table of rates is broadcast.
BROADCAST_SOURCES = 100_000
#: Digests of rows that repeat up to which they are broadcast.
BROADCAST_ROWS = 200_000


def uniform(*parts) -> Column:
    """A number in [0, 1) from the md5 of the parts, 52 bits of it: alike wherever and how often it is computed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson_table(mean: Column) -> Column:
    """array<double>: chances of at most 0, 1, 2, ... events."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["cdf"]


def source_rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, key: str = "source") -> DataFrame:
    """Rows source, n, rate: the mean number of copies of each document of a source.

    weights: rows (source, weight >= 0), null a source of its own; sources without a row have weight 0.
    Without weights all sources weigh alike. total: documents wanted in all, as many as docs has if None.
    """
    n = docs.groupBy(F.col(key).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        w = n.withColumn("weight", F.lit(1.0))
    else:
        given = weights.groupBy(F.col("source").alias("__s")).agg(F.sum("weight").alias("__w"))
        w = n.join(given, n["source"].eqNullSafe(given["__s"]), "left").select("source", "n", F.coalesce("__w", F.lit(0.0)).cast("double").alias("weight"))
    w = saved(w, "rates")
    sums = w.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    wanted = float(sums.n or 0) if total is None else float(total)
    share = F.col("weight") / F.lit(float(sums.w)) if sums.w else F.lit(0.0)
    return w.select("source", "n", (share * F.lit(wanted) / F.col("n")).alias("rate"))


def row_digest(docs: DataFrame) -> Column:
    """md5 of a row's columns as text, each with its length before it and nulls apart, so that only equal rows have equal ones."""
    texts = [F.col(f"`{c}`").cast("string") for c in docs.columns]
    return F.md5(F.concat(*(F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def numbered_rows(docs: DataFrame) -> DataFrame:
    """row (all columns), source, name: name is different for every row, and alike in every run: the row's digest and its number among equal rows.

    Only digests are counted to find rows that repeat. Of these, each task counts its own equal rows; a running count over
    the tasks' counts says which numbers a task's rows have. Equal rows are the same whichever of them has a number,
    so one stands for a task's and is repeated as often as it has numbers.
    """
    rows = docs.select("row", "source", "digest")
    again = saved(rows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "again")
    single = lambda df: df.select("row", "source", F.concat("digest", F.lit("#0")).alias("name"))
    if again.isEmpty():
        return single(rows)
    small = broadcast_if_small(again, BROADCAST_ROWS)
    held = rows.join(small, "digest", "left_semi").withColumn("part", F.spark_partition_id())
    held = saved(held.groupBy("digest", "part").agg(F.first("row").alias("row"), F.first("source").alias("source"), F.count("*").alias("n")), "repeated")
    # A row for each digest and task, whatever the number of equal rows.
    before = F.sum("n").over(Window.partitionBy("digest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.select("digest", "part", F.coalesce(before, F.lit(0)).alias("start"))
    numbered = held.join(starts, ["digest", "part"]).withColumn("k", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))
    numbered = numbered.select("row", "source", F.concat_ws("#", "digest", F.col("k").cast("string")).alias("name"))
    return single(rows.join(small, "digest", "left_anti")).unionAll(numbered)


def mix(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, seed: int = 0, key: str = "source", copy_col: str | None = "copy_no") -> DataFrame:
    """docs' columns and copy_col int (from 1), each row as often as its Poisson draw says, in shuffled order.

    A row's draw is the inverse of the Poisson distribution at a number hashed from seed, the row's own digest
    and its number among equal rows: a lost task gives the same copies again, and rows that share an id, or have none, or are
    alike in all columns are each drawn by themselves. A null source is a source of its own. An empty table stays
    empty. A column of docs named copy_col is replaced; with copy_col None, only docs' own columns are returned. The
    shuffle goes by a hash of row and copy, so a source or a document with many copies spreads over all partitions; draws of a
    source with a mean over DRAW_MEAN are made in parts, and a document's parts are dealt out before they become copies.
    """
    rates = saved(source_rates(docs, weights, total, key), "rates")
    parts = F.greatest(F.ceil(F.col("rate") / DRAW_MEAN), F.lit(1)).cast("int")
    rates = saved(rates.filter("rate > 0").select(F.col("source").alias("of"), parts.alias("parts"), poisson_table(F.col("rate") / parts).alias("cdf")), "cdfs")
    if copy_col:
        docs = docs.drop(copy_col)
    # In one column, the rows' own names can't clash with others.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{key}`").alias("source"), row_digest(docs).alias("digest"))
    rows = numbered_rows(rows)
    # The numbers first, so that each is worked out once and not for every term it is compared with.
    numbers = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: uniform(F.lit(str(seed)), F.col("name"), j.cast("string")))
    counts = F.transform(numbers, lambda u: F.size(F.filter("cdf", lambda c: c <= u)))
    joined = rows.join(broadcast_if_small(rates, BROADCAST_SOURCES), rows["source"].eqNullSafe(F.col("of")))
    drawn = joined.select("row", "name", counts.alias("counts"))
    if rates.filter("parts > 1").isEmpty():
        drawn = drawn.select("row", "name", F.lit(0).alias("before"), F.get("counts", F.lit(0)).alias("n"))
    else:
        start = F.struct(F.lit(0).alias("before"), F.expr("cast(array() as array<struct<before:int,n:int>>)").alias("parts"))
        step = lambda acc, n: F.struct((acc["before"] + n).alias("before"), F.concat(acc["parts"], F.array(F.struct(acc["before"].alias("before"), n.alias("n")))).alias("parts"))
        drawn = drawn.select("row", "name", F.explode(F.aggregate("counts", start, step)["parts"]).alias("p")).select("row", "name", "p.before", "p.n").filter("n > 0")
        drawn = drawn.repartition("name", "before")
    copies = drawn.filter("n > 0").select("row", "name", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("copy"))
    order = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), "name", F.col("copy").cast("string")))
    dealt = copies.select("row", "copy", order.alias("order")).repartition("order").sortWithinPartitions("order")
    return dealt.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), *([F.col("copy").alias(copy_col)] if copy_col else []))


#: mix() of documents with equal weights in SQL; ln(k!) as a sum keeps to plain functions.
_TEXTS = " || ".join(f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "text", "lang", "source", "n_chars"))
SQL = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) * 1.0 / count(*) AS per FROM n),
r AS (SELECT source, per / n AS rate, greatest(CAST(ceil(per / n / {DRAW_MEAN}) AS INTEGER), 1) AS parts FROM n, t),
k AS (SELECT CAST(range AS INTEGER) AS k FROM range(0, {TERMS} + 1)),
f AS (SELECT a.k AS k, coalesce(sum(ln(b.k)), 0.0) AS lf FROM k AS a LEFT JOIN k AS b ON b.k BETWEEN 1 AND a.k GROUP BY a.k),
p AS (SELECT source, parts, k, exp(k * ln(rate / parts) - rate / parts - lf) AS p FROM r, f),
c AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
g AS (SELECT *, md5({_TEXTS}) AS digest FROM documents),
d AS (SELECT *, row_number() OVER () AS row_no, digest || '#' || CAST(row_number() OVER (PARTITION BY digest) - 1 AS VARCHAR) AS name FROM g),
u AS (SELECT row_no, d.source AS source, CAST('0x' || substr(md5('0:' || name || ':' || CAST(j.k AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source JOIN k AS j ON j.k BETWEEN 1 AND r.parts),
m AS (SELECT u.row_no AS row_no, count(*) AS m FROM u JOIN c ON c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u GROUP BY u.row_no)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, k.k AS copy_no FROM d JOIN m ON m.row_no = d.row_no JOIN k ON k.k BETWEEN 1 AND m.m
"""
