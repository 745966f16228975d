"""Tables written to the folder that all executors share, so that what is used several times is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder in local mode, and an error on a cluster."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="phrasewright-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame, tag: str = "table") -> DataFrame:
    """The same rows, written as Parquet and read again: later uses don't compute them anew, and lost executors don't matter."""
    path = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
