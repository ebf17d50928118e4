"""Helpers shared by the training-data operators: scratch tables and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    A machine-local folder is used only where that setting is absent on a local master; elsewhere that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/twigline-scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/twigline-{uuid.uuid4().hex[:12]}/{name}"
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(parent)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stable_key(*cols: str) -> Column:
    """64-bit hash of the columns, equal for equal rows: a reproducible random order."""
    return F.xxhash64(F.lit("twigline"), *[F.col(c) for c in cols])


def packed(columns: list[str]) -> Column:
    """Columns to keep, in one struct: their names can't meet those of an operator's own columns."""
    return (F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(0).alias("_"))).alias("_keep")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col("_keep").getField(c).alias(c) for c in columns]
