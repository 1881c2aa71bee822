"""Folders for tables that a job writes on its way: in the folder that all machines share, never on one machine of a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "lumenfold-core"


def root(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a new local folder only if a session of one machine names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("a cluster needs a folder that all its machines share: set spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="lumenfold-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder, which isn't made yet."""
    return f"{root(spark)}/{FOLDER}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table at ``path``, read back: whatever follows starts from it."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all these folders, once results that read them have been written."""
    remove(spark, f"{root(spark)}/{FOLDER}")
