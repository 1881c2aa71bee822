"""The incremental parts as Structured Streaming: summaries that grow as chunks arrive, continuity of consecutive
steps, running totals, resumable appends.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.overlap import plain_tokens
from ..sources.collections import USAGE
from ..sources.sinks import append_new
from .ordered import in_order

Step = Callable[[str | None, str], str]


def summaries(chunks: DataFrame, item: str, step: str, text: str, summary: Step, *, first: int = 0, patience: int | None = None, idle: int | None = None) -> DataFrame:
    """``item, summary_index, summary, status`` as chunks (numbered from ``first``) arrive in any order; each step is made once, in order (see :func:`ordered.in_order`).

    ``summary_index`` counts from 1 for the first chunk.
    """
    values = T.StructType([T.StructField("summary", T.StringType())])

    def made(last: str | None, _: int, chunk: str) -> tuple[str, tuple]:
        now = summary(last, chunk)
        return now, (now,)

    out = in_order(chunks, item, step, text, values, made, first=first, patience=patience, idle=idle)
    return out.select(item, (F.col("step") - first + 1).alias("summary_index"), "summary", "status")


def _bigrams(x: str) -> Counter:
    w = plain_tokens(x)
    return Counter(zip(w, w[1:], strict=False))


def continuity(steps: DataFrame, item: str, step: str, text: str, *, first: int = 0, patience: int | None = None, idle: int | None = None) -> DataFrame:
    """``item, step, overlap, f1, status`` of each step's bigrams with the step's before, as steps arrive in any order; the step after a gap has no row."""
    values = T.StructType([T.StructField("overlap", T.LongType()), T.StructField("f1", T.DoubleType())])

    def made(last: str | None, _: int, now: str) -> tuple[str, tuple | None]:
        if last is None:
            return now, None
        a, b = _bigrams(last), _bigrams(now)
        hits, total = (a & b).total(), a.total() + b.total()
        return now, (hits, 2 * hits / total if total else 0.0)

    return in_order(steps, item, step, text, values, made, first=first, patience=patience, idle=idle, across=False)


def spending_stream(spark: SparkSession, path: str) -> DataFrame:
    """Running totals by model of a log that is only appended to (for output mode ``complete`` or ``update``)."""
    log = spark.readStream.schema(USAGE).option("mode", "DROPMALFORMED").csv(path).where("total_cost is not null")  # pruned columns aren't checked
    return log.groupBy("model").agg(F.count("*").alias("calls"), F.sum("total_cost").alias("total_cost"))


def windowed(events: DataFrame, time: str, *keys: str, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window with a watermark; ``slide`` makes windows overlap."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")


def append_once(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Appends each key once, whatever is replayed: batches are checked against the table."""

    def save(batch: DataFrame, _: int) -> None:
        append_new(batch, path, keys)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
