"""Extract tables from OCR files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagegrid.operators.extraction import extract_tables
from pagegrid.sources.readers import RESPONSE, response_pages


def stream_ocr_json(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Pages of newly arrived OCR responses, one JSON file per document."""
    files = (
        spark.readStream.schema(RESPONSE)
        .option("multiLine", "true")
        .option("maxFilesPerTrigger", max_files)
        .json(path)
    )
    named = files.select(F.md5("_metadata.file_path").alias("doc_id"), "pages")
    return response_pages(named, ["doc_id"])


def stream_tables(
    pages: DataFrame,
    output: str,
    checkpoint: str,
    extract: Callable[[DataFrame], DataFrame] = extract_tables,
) -> StreamingQuery:
    """Append the table rows of every new page to a Parquet set, each file exactly once.

    The extraction keeps no state between pages, so it runs as a plain streaming
    projection; no watermark and no state store are needed.
    """
    return (
        extract(pages)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
