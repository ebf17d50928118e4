"""Queries over streams of documents.

Extraction is row-local, so a streaming DataFrame takes the same plan as a batch, with no state and no watermark.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from twigline.operators.extract import extract
from twigline.query import Query, QueryBuilder


def read_stream(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string", per_trigger: int = 64) -> DataFrame:
    """Parquet files of documents as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def stream_matches(
    stream: DataFrame, queries: Query | QueryBuilder | Iterable[Query | QueryBuilder], html_col: str = "html", keep: list[str] | None = None
) -> DataFrame:
    """Matches of a stream's documents; append mode suits any sink."""
    if not stream.isStreaming:
        raise ValueError("not a stream; use extract")
    return extract(stream, queries, html_col, keep, plan="local")
