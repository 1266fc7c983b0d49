"""Where tables are written: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        root = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quarry-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows written and read back: a plan without a past."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """The rows written and read back, and where."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
