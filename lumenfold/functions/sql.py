"""The operators for SQL users: functions registered in a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

CHUNK = StructType([StructField("chunk_index", IntegerType()), StructField("chunk", StringType())])


class ChunkText:
    """``chunk_text(text, size, delimiter)``: a row for each greedily packed chunk; null and empty texts have none."""

    def eval(self, text: str, size: int, delimiter: str) -> Iterator[tuple[int, str]]:
        if not text:
            return
        open_, used, n = [], 0, 0
        for unit in text.split(delimiter):
            total = used + len(unit) + (len(delimiter) if open_ else 0)
            if open_ and total > size:
                yield n, delimiter.join(open_)
                open_, total, n = [], len(unit), n + 1
            open_.append(unit)
            used = total
        yield n, delimiter.join(open_)


def register(spark: SparkSession) -> None:
    """Adds ``chunk_text`` (a table function) and the SQL functions ``word_count``, ``bare_tokens`` and ``share_percent``."""
    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType=CHUNK))
    for name, kind, body in (
        ("word_count", "INT", "size(filter(split(t, '(?U)\\\\s+', -1), w -> w <> ''))"),
        ("bare_tokens", "ARRAY<STRING>", "filter(split(lower(t), '[^a-z0-9]+', -1), w -> w <> '')"),
        ("share_percent", "DOUBLE", "try_cast(rtrim('%', trim(t)) AS DOUBLE) / 100"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
