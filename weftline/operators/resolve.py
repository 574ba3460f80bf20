"""Validate a requested name against a catalog and build the path it leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.url import is_member, random_member, url_param


def resolve(df: DataFrame, url: str, key: str, names, fallback: Column, prefix: str = "themes/") -> DataFrame:
    """Adds requested, valid, chosen and path.

    A parameter counts only if it is in names; otherwise the fallback is taken, so
    a URL can't lead to a path outside the catalog. Pure projection: no shuffle.
    """
    requested = url_param(F.col(url), key)
    return (
        df.withColumn("requested", requested)
        .withColumn("valid", is_member(F.col("requested"), names))
        .withColumn("chosen", F.when(F.col("valid"), F.col("requested")).otherwise(fallback))
        .withColumn("path", F.concat(F.lit(prefix), F.col("chosen")))
    )


def resolve_fixed(df: DataFrame, url: str, key: str, names, default: str, prefix: str = "themes/") -> DataFrame:
    """resolve() with one fixed fallback."""
    return resolve(df, url, key, names, F.lit(default), prefix)


def resolve_random(df: DataFrame, url: str, key: str, names, seed: int | None = None, prefix: str = "themes/", row_key: str | None = None) -> DataFrame:
    """resolve() with a fallback drawn uniformly from names.

    row_key: a column whose value decides, with the seed, what a row draws, whatever the partitions; without it each row
    draws anew, and a seed repeats that for the same partitions only.
    """
    drawn = random_member(names, seed, None if row_key is None else F.col(row_key))
    return resolve(df, url, key, names, drawn, prefix)


def resolve_against(df: DataFrame, url: str, key: str, catalog: DataFrame, default: str, prefix: str = "themes/") -> DataFrame:
    """resolve_fixed() for a catalog that is a table (column theme) of any size; the join is Spark's choice."""
    names = catalog.select(F.col("theme").alias("__name")).distinct()
    asked = df.withColumn("requested", url_param(F.col(url), key))
    found = asked.join(names, F.col("requested") == F.col("__name"), "left")
    return (
        found.withColumn("valid", F.col("__name").isNotNull())
        .withColumn("chosen", F.coalesce("__name", F.lit(default)))
        .withColumn("path", F.concat(F.lit(prefix), F.col("chosen")))
        .drop("__name")
    )
