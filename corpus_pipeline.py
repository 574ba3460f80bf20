"""From raw documents to token files: quality, near duplicates, benchmark leaks, mixing, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, mixing, near, quality, queries, token_files
from weftline.llm.common import Intermediates, discard, saved, table


def quality_votes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels, takes for good.

    Null and empty texts get the share of good ones in the labelled rows; each row goes by its own text, whatever its id. All
    columns stay as they are, those named as the classifier's own too. An empty table stays empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return quality.classify(rows, model).filter("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8 or more.

    Of a group the row with the smallest id stays, the first written of several; null ids come last. Texts without words (null,
    empty) are no copies of each other and all stay.
    """
    return near.without_copies(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's copy, whole, edited or cut. Each row goes by its own text; null and empty ones match nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources at equal weights, as many documents in all as there are, shuffled.

    Each row is drawn by itself, those that share an id or are alike too; a null source is a source of its own. Own columns all stay.
    """
    return mixing.mix(docs, copy_col=None)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the mixed order, and what is read back from them for each document: doc_id, start, n_tokens, ids_crc32. Null texts count as empty: the end id alone."""
    return token_files.token_digests(docs, queries.tokenizer_path(), ordered=False)


STAGES = [
    ("quality_votes", quality_votes),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

#: SQL can't express the stages: tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's own tables and broadcasts go when its result is written, the result when the next one's is; the last result and the token files stay."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with Intermediates(spark) as made:
            docs = made.kept(saved(stage(spark, docs, sf_dir), name))
        discard(*before)
        before = [docs]
    return docs
