"""Shared plumbing of the training-data operators: tables, scratch storage, Arrow helpers.

Nothing here holds data on the driver.  Scratch data goes to the folder that the session names in
``spark.checkpoint.dir``; only where that is unset (tests, notebooks) is a local folder chosen.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to Python.  Whole texts travel in them, so the default of 10,000 is too many; a worker holds several times a batch, and keeps what it once took.
ARROW_ROWS = 250


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches of this session from now on: at most ``rows`` rows and, whatever is set last, 16 MB each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a new local one only if a session of one machine names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise ValueError("a cluster needs a folder that all its machines share: set spark.checkpoint.dir")
    if not named:
        named = tempfile.mkdtemp(prefix="lumenfold-")
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike a checkpoint it is compressed and columnar.  :func:`clear_scratch` removes all such tables.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/lumenfold-scratch/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._lumenfold_path = path
    return back


def discard(table: DataFrame) -> None:
    """Delete a table of :func:`written` that all its readers have been written out from; they are tables of their own, so none is lost."""
    _delete(table.sparkSession, table._lumenfold_path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that :func:`written` has left in the shared folder."""
    _delete(spark, f"{scratch_dir(spark).rstrip('/')}/lumenfold-scratch")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over now, not when the driver next happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(name: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column or the values of a binary one, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
