"""Intermediate tables below the folder that driver and executors share, so that a lost executor costs a reread."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs on one machine, as in tests.
LOCAL = "file:///tmp/checkpoints/tidemark"


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session."""
    given = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (given or LOCAL).rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table that has been written and is read again; it is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(drop, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already
        pass
