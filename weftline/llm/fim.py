"""Fill-in-middle transformation: DuckDB's SQL over each Arrow batch inside mapInArrow."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_steps

#: Signs before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, those that are cut, and of those the ones whose suffix comes first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
#: A unit, which is never cut in two: a run of ASCII letters or any other character.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Bytes of text that one statement works on; a longer text is a statement of its own.
STEP = 4_000_000

_SCHEMA = "doc_id long, n long, form string, output string, prefix_chars long, middle_chars long"


def transform_sql(seed: int, cut_percent: int, suffix_first_percent: int) -> str:
    """The statement over a table batch (doc_id, text)."""
    number = "CAST('0x' || h[{}:{}] AS BIGINT)"
    h1, h2, h3, h4 = (number.format(8 * k + 1, 8 * k + 8) for k in range(4))
    signs = " OR ".join(f"contains(text, '{s}')" for s in (PREFIX, SUFFIX, MIDDLE))
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM batch),
u AS (SELECT doc_id, text, regexp_extract_all(text, '{UNIT}') AS units, {h1} AS h1, {h2} AS h2,
  CASE WHEN text = '' OR {signs} OR {h3} % 100 >= {cut_percent} THEN 'plain' WHEN {h4} % 100 < {suffix_first_percent} THEN 'spm' ELSE 'psm' END AS form FROM a),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS i, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS j FROM u),
p AS (SELECT doc_id, text, form, n, array_to_string(list_slice(units, 1, i), '') AS prefix, array_to_string(list_slice(units, i + 1, j), '') AS middle, array_to_string(list_slice(units, j + 1, n), '') AS suffix FROM c)
SELECT doc_id, n, form,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars
FROM p"""


def fill_in_middle(docs: DataFrame, seed: int = 1, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, output, prefix_chars, middle_chars: one row a document, repeated rows too.

    Two cuts between units are drawn from the sha256 of seed and id, so that a lost task gives the same again.
    form psm: prefix, suffix, middle, each after its sign; spm: suffix first; plain: the text as it is, for
    empty texts, texts that hold a sign, and 100 - cut_percent of 100 others. The two counts are
    characters (code points), null for plain. Null texts count as empty; a null id draws as an empty one would, so rows
    that repeat an id, or have none, are drawn alike. Bytes that aren't UTF-8 are replaced on reading. A text is held whole, in one task. Other
    columns are left out; an empty table gives no rows. No shuffle.
    """
    sql = transform_sql(seed, cut_percent, suffix_first_percent)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_col)).alias("text"))
    # pa.Schema isn't built on the driver: the workers need it only.
    kinds = {"doc_id": "int64", "n": "int64", "form": "string", "output": "string", "prefix_chars": "int64", "middle_chars": "int64"}

    def transformed(batches):
        import duckdb

        schema = pa.schema([(k, pa.type_for_alias(v)) for k, v in kinds.items()])
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for step in arrow_steps(batches, "text", STEP):
                con.register("batch", pa.Table.from_batches([step]))
                yield from con.sql(sql).to_arrow_table().cast(schema).to_batches()
                con.unregister("batch")

    return rows.mapInArrow(transformed, _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form were made from: no text that was cut holds a sign, so each stands in the output once."""
    part = lambda text, sign, k: F.split_part(text, F.lit(sign), F.lit(k))
    middle, rest = part(output, MIDDLE, 2), part(output, MIDDLE, 1)
    prefix_first = F.concat(F.substring(part(rest, SUFFIX, 1), len(PREFIX) + 1, 1 << 30), middle, part(rest, SUFFIX, 2))
    suffix_first = F.concat(part(rest, PREFIX, 2), middle, F.substring(part(rest, PREFIX, 1), len(SUFFIX) + 1, 1 << 30))
    return F.when(form == "psm", prefix_first).when(form == "spm", suffix_first).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """made (of fill_in_middle) with digests of output and restored text in place of the texts."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The digests in SQL by places of characters: the cuts come from the lengths of the units before them, the restored text is the text.
SQL = f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, list_transform(regexp_extract_all(coalesce(text, ''), '{UNIT}'), lambda x: length(x)) AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
b AS (SELECT doc_id, t, w, len(w) AS n, list_transform(range(4), lambda k: CAST('0x' || substr(h, CAST(8 * k + 1 AS BIGINT), 8) AS BIGINT)) AS r FROM a),
c AS (SELECT *, coalesce(list_sum(w[1:least(r[1] % (n + 1), r[2] % (n + 1))]), 0) AS i, coalesce(list_sum(w[1:greatest(r[1] % (n + 1), r[2] % (n + 1))]), 0) AS j,
  CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR r[3] % 100 >= {CUT_PERCENT} THEN 'plain' WHEN r[4] % 100 < {SUFFIX_FIRST_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM b),
d AS (SELECT *, substr(t, 1, CAST(i AS BIGINT)) AS pre, substr(t, CAST(i AS BIGINT) + 1, CAST(j - i AS BIGINT)) AS mid, substr(t, CAST(j AS BIGINT) + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(i AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(j - i AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM d
"""
