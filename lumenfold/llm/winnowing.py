"""Document fingerprints by winnowing.

Every k-gram of characters has a rolling hash; of each window of w neighbouring hashes the smallest is kept, the
rightmost if it ties, with its position.  Any match of ``k + w - 1`` characters shares a kept hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import partitions, small_batches, strings

GRAM, WINDOW = 12, 24
_MULT = 0x9E3779B97F4A7C15


class Kept(NamedTuple):
    hashes: np.ndarray
    positions: np.ndarray


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def winnow(codes: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> Kept:
    """Kept hashes (32 bits) and positions of code points; a text shorter than a gram is one gram, an empty one has none."""
    n = len(codes)
    if not n:
        return Kept(np.zeros(0, np.uint32), np.zeros(0, np.int32))
    gram = min(gram, n)
    h = codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) ^ (codes.astype(np.uint64) << np.uint64(33))
    have, mult = 1, _MULT
    doubled = [(1, h)]
    while have * 2 <= gram:
        h = h[: len(h) - have] * np.uint64(pow(mult, have, 1 << 64)) + h[have:]
        have *= 2
        doubled.append((have, h))
    rolled, have = None, 0
    for step, x in reversed(doubled):
        if have + step <= gram:
            rolled = x if rolled is None else rolled[: len(x) - have] * np.uint64(pow(mult, step, 1 << 64)) + x[have:]
            have += step
    rolled = rolled ^ (rolled >> np.uint64(29))
    rolled = (rolled * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
    m = len(rolled)
    window = min(window, m)
    # hash above, distance from the end below: the least of these is the rightmost least hash
    packed = (rolled << np.uint64(32)) | np.arange(m - 1, -1, -1, dtype=np.uint64)
    size = 1
    while size * 2 <= window:
        packed = np.minimum(packed[:-size], packed[size:])
        size *= 2
    if window > size:
        packed = np.minimum(packed[: len(packed) - (window - size)], packed[window - size :])
    first = np.concatenate(([True], packed[1:] != packed[:-1]))
    packed = packed[first]
    return Kept((packed >> np.uint64(32)).astype(np.uint32), (m - 1 - (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)).astype(np.int32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of kept hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def written_out(kept: Kept) -> str:
    """The kept hashes in order, eight hexadecimal digits each."""
    return kept.hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, hashes, positions`` of each whole text (null reads as empty: no hashes)."""
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [winnow(_codes(x), gram, window) for x in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.hashes.astype(np.int64) for x in kept], pa.list_(pa.int64())), pa.array([x.positions for x in kept], pa.list_(pa.int32()))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


NEIGHBOURS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
    ]
)


def dealt_in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``bucket, extra, doc_id, text``, hashed by bucket and sorted within partitions.

    Buckets are ranges of ids, several for each partition.  The first row of each comes again, marked ``extra``, at the end of the bucket before
    (of the first bucket: at the end of the last), so that every row stands beside its successor.  Only ids are looked at to draw the
    bounds; the driver holds, and broadcasts, bounds and first ids: a few numbers for each bucket, whose number is four times that of partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    aim = 4 * partitions(spark)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("double")
    ids = rows.select("doc_id").withColumn("key", key)
    cuts = sorted(set(ids.approxQuantile("key", [k / aim for k in range(1, aim)], 0.25 / aim)))
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="key", outputCol="b").transform
    firsts = bucketed(ids).groupBy("b").agg(F.min("key").alias("k")).orderBy("b").collect()
    order = [int(x["b"]) for x in firsts]
    before = {int(x["b"]): order[k - 1] for k, x in enumerate(firsts)}
    bounds = spark.createDataFrame([(int(x["b"]), float(x["k"]), before[int(x["b"])]) for x in firsts], "b int, head double, previous int")
    numbered = bucketed(rows.withColumn("key", key)).withColumn("b", F.col("b").cast("int")).join(F.broadcast(bounds), "b")
    once = F.struct(F.col("b").alias("bucket"), F.lit(False).alias("extra"))
    again = F.struct(F.col("previous").alias("bucket"), F.lit(True).alias("extra"))
    placed = numbered.withColumn("at", F.explode(F.when(F.col("key") == F.col("head"), F.array(once, again)).otherwise(F.array(once))))
    dealt = placed.select("at.bucket", "at.extra", "doc_id", "text").repartition(partitions(spark), "bucket")
    return dealt.sortWithinPartitions("bucket", "extra", "doc_id", "text")


def beside_next(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of the text with its second half replaced from the next document, and their likeness.

    The next document is that of the next id (after the last: the first); rows that repeat an id follow each other in
    the order of their texts, null ids come first.  A single document is its own next.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, id, text, codes, fingerprint of the row before
        done = None  # bucket whose first extra row has been met
        for batch in batches:
            rows = []
            for bucket, extra, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strings(batch.column(3)), strict=True):
                if extra and done == bucket:
                    continue
                codes = _codes(text)
                kept = winnow(codes, gram, window)
                if held is not None and held[0] == bucket:
                    _, own, mine, mine_kept = held
                    half = len(mine) // 2
                    edited = np.concatenate((mine[: len(mine) - half], codes[:half]))
                    other = winnow(edited, gram, window)
                    data = edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
                    rows.append((own, len(mine), hashlib.sha256(data).hexdigest(), written_out(mine_kept), written_out(other), likeness(mine_kept.hashes, other.hashes), likeness(mine_kept.hashes, kept.hashes), mine_kept.positions))
                held = None if extra else (bucket, doc, codes, kept)
                done = bucket if extra else done
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NEIGHBOURS.names)

    return dealt_in_order(docs, id_col, text_col).mapInArrow(run, NEIGHBOURS)
