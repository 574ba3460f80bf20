"""Chat formatting with the perspective rotated over all participants. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import broadcast_if_small, saved

#: Turn numbers that go into one part, and rows from which on a part is cut into slices.
PART, CROWD = 256, 1024
#: Rows up to which crowded parts and their turns are broadcast.
BROADCAST_PARTS = 200_000

START, END = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    # A text can't open or close a message of the template.
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    both = [a[k].eqNullSafe(b[f"__{k}"]) for k in keys]
    return both[0] if len(both) == 1 else both[0] & _same(a, b, keys[1:])


def sliced(rows: DataFrame, part: int, crowd: int) -> DataFrame:
    """rows (conv_id, part, turn, who, said) with slice and copies: parts of up to crowd rows are slice 0, larger ones are cut into slices of about `part` rows.

    A crowded part's slices follow its turn numbers, by running counts; the rows of one number are dealt over the
    number's slices by a hash. Equal rows are counted before they are dealt, and go on in packets of up to `part`.
    """
    where = ["conv_id", "part"]
    crowded = saved(rows.groupBy(*where).agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select(*(F.col(k).alias(f"__{k}") for k in where)), "crowded")
    small = broadcast_if_small(crowded, BROADCAST_PARTS)
    plain = rows.join(small, _same(rows, small, where), "left_anti").select("*", F.lit(0).cast("long").alias("slice"), F.lit(1).cast("long").alias("copies"))

    inside = rows.join(small, _same(rows, small, where), "left_semi")
    # A part has at most part + 1 turn numbers, the missing one among them.
    before = F.sum("n").over(Window.partitionBy(*where).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    turns = inside.groupBy(*where, "turn").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    turns = turns.select(*(F.col(k).alias(f"__{k}") for k in [*where, "turn"]), F.floor(F.col("before") / part).alias("first"), F.floor((F.col("before") + F.col("n") - 1) / part).alias("last"))
    turns = broadcast_if_small(saved(turns, "turns"), BROADCAST_PARTS)

    packets = inside.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / part))))
    place = F.col("first") + F.pmod(F.xxhash64("who", "said", "packet"), F.col("last") - F.col("first") + 1)
    dealt = packets.join(turns, _same(packets, turns, [*where, "turn"])).select(*rows.columns, place.alias("slice"), F.least(F.lit(part), F.col("n") - F.col("packet") * part).alias("copies"))
    return plain.unionByName(dealt)


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: tuple[str, ...] = ("system",), part: int = PART, crowd: int = CROWD) -> DataFrame:
    """One row for each conversation, participant, part and slice: conv_id, speaker, part, slice, n_turns, n_own, text, mask.

    Participants are the different speakers of a conversation other than system names. In a participant's
    row their turns are rendered as the assistant's, all other participants' as users with a name, and system
    turns as such. mask array<struct<start,stop>>: the character ranges of text to train on, which are that
    participant's words with the closing mark. A conversation without participants gives no row.

    Part k holds the turns numbered k * part to (k + 1) * part - 1, so that a conversation of any length is
    rendered by many tasks; parts and slices read in order make up the whole. A part is one slice, unless it has
    over crowd rows, as where many rows share a turn number; then see sliced(). Rows without a turn number have no
    place in the order; they come first in part -1. Null speakers are a participant named
    "unknown", null texts are empty. Turns with the same number are ordered by slice, speaker and text; repeated
    rows are all rendered. A null conversation id is an id of its own. "<|" in texts and names gets a space
    between its signs, white space in names becomes "_". Other columns are left out; an empty table gives no rows.
    """
    name = F.coalesce(F.col(speaker_col), F.lit("unknown"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        name.alias("who"),
        text.alias("said"),
    )
    at = F.coalesce(F.floor(F.col("turn") / part), F.lit(-1)).cast("long")
    held = F.sort_array(F.collect_list(F.struct("turn", "who", "said", "copies")))
    repeated = F.flatten(F.transform("turns", lambda t: F.array_repeat(t, t["copies"].cast("int"))))
    parts = sliced(rows.withColumn("part", at), part, crowd).groupBy("conv_id", "part", "slice").agg(held.alias("turns")).withColumn("turns", repeated)
    people = rows.filter(~F.col("who").isin(*system)).groupBy("conv_id", F.col("who").alias("speaker")).agg(F.lit(1).alias("one"))
    both = parts.join(people.withColumnRenamed("conv_id", "__c"), F.col("conv_id").eqNullSafe(F.col("__c")))

    def opened(t: Column) -> Column:
        named = F.regexp_replace(_safe(t["who"]), r"\s", "_")
        return (
            F.when(t["who"] == F.col("speaker"), F.lit(f"{START}assistant\n"))
            .when(t["who"].isin(*system), F.lit(f"{START}system\n"))
            .otherwise(F.concat(F.lit(f"{START}user name="), named, F.lit("\n")))
        )

    pieces = F.transform("turns", lambda t: F.struct((t["who"] == F.col("speaker")).alias("own"), opened(t).alias("head"), F.concat(_safe(t["said"]), F.lit(END)).alias("body")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"))

    def step(acc, p):
        begin = (acc["at"] + F.length(p["head"])).cast("int")
        stop = (begin + F.length(p["body"])).cast("int")
        spans = F.when(p["own"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), stop.alias("stop"))))).otherwise(acc["spans"])
        return F.struct((stop + 1).cast("int").alias("at"), spans.alias("spans"))

    out = both.withColumn("pieces", pieces)
    return out.select(
        "conv_id",
        "speaker",
        "part",
        "slice",
        F.size("turns").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).alias("n_own"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("pieces", start, step)["spans"].alias("mask"),
    )


def with_text_mask(rotated: DataFrame) -> DataFrame:
    """mask as text, `start-stop` joined by commas, for comparing results."""
    return rotated.withColumn("mask", F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ","))


#: No part of the tables at hand has over CROWD rows, so that slice is 0.
SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS who, replace(coalesce(text, ''), '<|', '< |') AS said, CAST(floor(turn / {PART}.0) AS BIGINT) AS part FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, who AS speaker FROM t WHERE who <> 'system'),
m AS (SELECT conv_id, speaker, part, turn, who, said, who = speaker AS own,
  CASE WHEN who = speaker THEN '{START}assistant' WHEN who = 'system' THEN '{START}system' ELSE '{START}user name=' || who END || chr(10) AS head, said || '{END}' AS body FROM t JOIN p ON t.conv_id = p.c),
s AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn, who, said ROWS UNBOUNDED PRECEDING) - length(body) - 1 AS begin FROM m)
SELECT conv_id, speaker, part, CAST(0 AS BIGINT) AS slice, CAST(count(*) AS INTEGER) AS n_turns, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS INTEGER) AS n_own,
  string_agg(head || body || chr(10), '' ORDER BY turn, who, said) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(CAST(begin AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begin + length(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn, who, said), '') AS mask
FROM s GROUP BY conv_id, speaker, part
"""
