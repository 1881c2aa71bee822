"""Results on storage: Parquet tables as the canonical form, JSON files and CSV as exports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import spreadsheet_safe
from ..operators.analysis import not_done


def run_hash(params: dict) -> str:
    """Six hexadecimal digits of the parameters in sorted order."""
    return hashlib.md5(json.dumps(params, sort_keys=True).encode()).hexdigest()[:6]


def run_id(source: str, kind: str, params: dict) -> str:
    return f"{source}_{kind}_{run_hash(params)}"


def save_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None, mode: str = "error") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends rows whose key the table doesn't have and says how many: running it again adds nothing."""
    from .collections import exists

    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    if exists(spark, path):
        new = not_done(new, spark.read.parquet(path), keys)
    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def export_json(df: DataFrame, path: str, key: str) -> None:
    """A folder for each key with the row as JSON lines, written by executors."""
    df.select(F.col(key), F.to_json(F.struct(*df.columns)).alias("value")).write.partitionBy(key).text(path)


def export_collection(spark: SparkSession, items: DataFrame, info: dict, path: str) -> None:
    """``collection.json`` with the counts filled in, and the items beside it."""
    n = items.count()
    text = json.dumps(info | {"num_items": n}, indent=2, ensure_ascii=False)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/collection.json")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    items.select(F.to_json(F.struct(*items.columns)).alias("value")).write.mode("overwrite").text(f"{path}/items")


def export_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """A CSV folder with a header; texts are safe to open as a spreadsheet."""
    safe = [spreadsheet_safe(f.name).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in df.schema]
    df.select(*safe).write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def log_usage(df: DataFrame, path: str) -> None:
    """Appends to the spending log: eight columns, no header."""
    df.select("ts", "model", "input_tokens", "output_tokens", "total_tokens", "input_cost", "output_cost", "total_cost").write.mode("append").csv(path)


def results_and_errors(df: DataFrame, path: str, error: str = "error") -> None:
    """Rows without and with an error, as two tables."""
    df.where(F.col(error).isNull()).drop(error).write.parquet(f"{path}/results")
    df.where(F.col(error).isNotNull()).write.parquet(f"{path}/errors")
