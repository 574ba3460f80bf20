"""Page requests as a stream: the batch operator, unchanged, over readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.resolve import resolve_fixed

REQUEST_SCHEMA = "page_id long, url string, html string"


def request_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New parquet files in a folder, as they come."""
    return spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_resolved(requests: DataFrame, key: str, names, default: str, out: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once parquet of (page_id, path); stateless, so no watermark is needed. Ends when the input is used up."""
    done = resolve_fixed(requests, "url", key, names, default).select("page_id", "path")
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
