"""Documents in, matches out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_html_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, html) of whole text files."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("html"))


def read_html_bytes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, html) of files as UTF-8 bytes, from any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file"), F.col("content").alias("html"))


def from_strings(spark: SparkSession, documents: list[str | None]) -> DataFrame:
    """(doc_id, html) of documents at hand."""
    return spark.createDataFrame(list(enumerate(documents)), "doc_id long, html string")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included."""
    df.write.option("ignoreNullFields", "false").json(path)
