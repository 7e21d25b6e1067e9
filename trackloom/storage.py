"""Where jobs keep tables that more than one of them reads: a folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; on a local master, where that is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not found and jsc.getCheckpointDir().isDefined():
        found = jsc.getCheckpointDir().get()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="trackloom-"))
        found = jsc.getCheckpointDir().get()
    return f"{found.rstrip('/')}/trackloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def overwritten(df: DataFrame, path: str, *partition: str) -> None:
    """Writes ``df``, replacing the partitions it has rows for and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: derived once, however often it is read."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
