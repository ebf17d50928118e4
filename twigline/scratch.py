"""Folders for intermediate tables that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, removed when the driver's JVM ends.

    A machine-local folder is used only where that setting is absent on a local master; elsewhere that is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/twigline-shared"
    path = f"{root.rstrip('/')}/twigline-{uuid.uuid4().hex[:12]}/{name}"
    parent = context._jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(parent)
    return path
