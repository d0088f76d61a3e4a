"""Folders for tables that outlive a stage, in the place all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where the setting is absent and Spark
    runs in one process, a temporary folder is set for the session; a cluster needs it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="beamline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/beamline-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written there and read back: what follows does not make it again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
