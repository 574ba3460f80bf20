"""Query-string parameters as Column expressions, with the browser's rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_decoded(part: Column) -> Column:
    """A component as a browser reads it: `+` is a space, each `%` with two hex digits a byte, any other `%` itself; bytes that aren't UTF-8 become U+FFFD."""
    pieces = F.split(F.replace(part, F.lit("+"), F.lit(" ")), "%")
    escaped = F.transform(
        F.slice(pieces, 2, F.size(pieces)),
        lambda p: F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.substring(p, 1, 2), F.hex(F.substring(p, 3, 1 << 30)))).otherwise(F.concat(F.lit("25"), F.hex(p))),
    )
    joined = F.unhex(F.concat(F.hex(F.get(pieces, F.lit(0))), F.array_join(escaped, "")))
    return F.when(part.rlike("[+%]"), F.make_valid_utf8(joined.cast("string"))).otherwise(part)


def query_pairs(url: Column) -> Column:
    """array<struct<k,v>> of the query string, decoded, in order, repeats kept. Fragments don't count; null url: null."""
    query = F.regexp_extract(url, "^[^?#]*[?]([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            url_decoded(F.split_part(p, F.lit("="), F.lit(1))).alias("k"),
            url_decoded(F.regexp_replace(p, "^[^=]*=?", "")).alias("v"),
        ),
    )


def url_param(url: Column, key: str) -> Column:
    """First value of key: empty text for `?key` and `?key=`, null where the key is absent."""
    found = F.filter(query_pairs(url), lambda e: e["k"] == key)
    return F.get(found, F.lit(0))["v"]


def is_member(value: Column, names) -> Column:
    """Membership in a constant list: false, not null, for a null value."""
    return F.coalesce(value.isin(*names), F.lit(False)) if names else F.lit(False)


def keyed_number(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the md5 of seed and key, 52 bits of it: alike wherever and how often it is computed. A null key counts as empty."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def random_member(names, seed: int | None = None, key: Column | None = None) -> Column:
    """One element of a constant list, each with equal chance.

    With a key the draw is hashed from seed (0 if None) and key, so it repeats for any partitioning and rows of one key draw alike;
    without, it is Spark's rand(), which a seed repeats for the same partitions only.
    """
    options = F.array(*map(F.lit, names))
    number = F.rand(seed) if key is None else keyed_number(key, seed or 0)
    return F.get(options, F.floor(number * F.size(options)).cast("int"))
