"""Exact dedup by deterministic block naming. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bitmap_rows, discard, has_bit, saved

#: Bytes of a block.
BLOCK = 1024
#: Bits of the map of recurring hashes that is broadcast (16 MB), 2 to this power. A full one lets more blocks be compared, but no result changes.
MAP_BITS = 27


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, hashed=F.xxhash64) -> DataFrame:
    """Rows row, doc_id, text_sha256, level, name: two rows have equal texts just when level and name are equal.

    Level 0: each block of `block` bytes gets an integer name, equal blocks the same (the smallest number
    among their places, so names never collide). Level k + 1 names adjacent pairs of names of level k, an odd
    last one paired with -1. A document is done at the level where one name is left, which its number of
    blocks decides. A level has half the rows of the one before, and the longest document sets their number.

    Blocks are dealt by a hash, but compared whole, the least and greatest bytes of a hash being equal or not. Only
    blocks whose hash occurs again take part: a bit map of those hashes tells them where they lie, so the bytes
    of other blocks aren't moved. hashed: another hash of a block, for tests.
    """
    data = F.col("__text").cast("binary")
    count = F.greatest(F.ceil(F.length(data) / F.lit(block)), F.lit(1)).cast("int")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("__text"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("__data"), i * block + 1, F.lit(block)))
    rows = rows.select("row", "doc_id", F.sha2(data, 256).alias("sha"), data.alias("__data"), count.alias("n"))
    rows = rows.select("row", "doc_id", "sha", "n", F.posexplode(cut).alias("pos", "block"))
    first = F.col("pos") == 0
    blocks = saved(
        rows.select("row", "pos", "n", "block", hashed("block").alias("h"), F.monotonically_increasing_id().alias("place"), F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha")),
        "blocks",
    )
    # Sums are written before they are joined, so that a join deals out both its sides and Spark can split a frequent block or pair.
    again = saved(blocks.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "again")
    marks = saved(bitmap_rows(again, MAP_BITS), "marks")
    bucket = F.shiftrightunsigned("h", 64 - MAP_BITS + 15)
    marked = blocks.withColumn("bucket", bucket).join(F.broadcast(marks), "bucket", "left")
    able = marked.filter(has_bit(F.col("h"), MAP_BITS, F.col("map"))).groupBy("h").agg(F.count("*").alias("c"), F.min("block").alias("low"), F.max("block").alias("high"), F.min("place").alias("name"))
    able = saved(able.filter("c > 1").select("h", "name", (F.col("low") != F.col("high")).alias("mixed")), "named")
    places = blocks.select("row", "pos", "n", "place", "h")
    level = places.join(able.hint("merge"), "h", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    several = able.filter("mixed").select("h")
    if several.isEmpty():
        level = level.select("row", "pos", "n", "place", F.coalesce("name", "place").alias("name"))
    else:  # one hash of different blocks: these are named by their bytes
        alike = saved(blocks.join(several, "h").select("row", "pos", "n", "place", "h", "block"), "alike")
        apart = saved(alike.groupBy("h", "block").agg(F.min("place").alias("name")), "apart")
        level = level.filter(~F.col("mixed")).select("row", "pos", "n", "place", F.coalesce("name", "place").alias("name"))
        level = level.unionAll(alike.join(apart, ["h", "block"]).select("row", "pos", "n", "place", "name"))
    level = saved(level, "names")
    discard(again, marks, able)
    most, done, k = blocks.agg(F.max("n")).first()[0] or 0, [], 0
    while True:
        done.append(level.filter("n = 1").select("row", F.lit(k).alias("level"), "name"))
        if most <= 1:
            break
        even = F.col("pos") % 2 == 0
        pairs = level.filter("n > 1").groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
            F.min("place").alias("place"),
            F.floor((F.max("n") + 1) / 2).cast("int").alias("n"),
        )
        pairs = saved(pairs, "pairs")
        names = saved(pairs.groupBy("a", "b").agg(F.min("place").alias("name")), "named")
        level = saved(pairs.join(names.hint("merge"), ["a", "b"]).select("row", "pos", "n", "place", "name"), "names")
        discard(pairs, names)
        most, k = (most + 1) // 2, k + 1
    heads = blocks.filter("pos = 0").select("row", "doc_id", F.col("sha").alias("text_sha256"))
    return heads.join(reduce(DataFrame.unionAll, done), "row")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, hashed=F.xxhash64) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the smallest id of a group of equal texts is kept (null ids come last; of rows that repeat
    an id the first as numbered on reading), so each group keeps just one row. Null and empty texts are equal.
    Other columns are left out; an empty table gives no rows.
    """
    named = saved(block_names(docs, id_col, text_col, block, hashed), "identity")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    # Written, so that the join below deals both its sides out anew and Spark can split a large group.
    groups = saved(named.groupBy("level", "name").agg(F.min(rank).alias("keep"), F.count("*").alias("group_size")), "groups")
    out = named.join(groups.hint("merge"), ["level", "name"])
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256")


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256 FROM t
"""
