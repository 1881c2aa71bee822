"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

An n-gram's feature is whether it occurs in the lower-cased text, times the log of the ratio of its smoothed shares in toxic
and other texts; a ridge logistic regression weighs the features.  All n-grams take part whose shares differ beyond chance, in
either direction.  The model is fitted on a bounded sample of the labelled rows, copies of a text once; gradients are summed
by Spark, so the driver holds one number for each feature.  It is a vector of one weight per hash bucket, so scoring is
one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small_batches, strings, text_column, written

#: Lengths of the n-grams, and the hash buckets that they share.
GRAMS = (4, 5)
BUCKETS = 1 << 20
#: Labelled rows that a model is fitted on at most, those of the smallest hashes.
SAMPLE_ROWS = 20_000
#: Standard deviations by which an n-gram's shares in toxic and other texts differ at least: of a million buckets half a one reaches it by chance.
LEAST_Z = 5.0
#: Added to the counts in the ratios.
SMOOTH = 1.0
RIDGE = 0.3
#: Steps of the fit at most, and the share of the loss that a step must gain to go on.
STEPS, LEAST_GAIN = 60, 1e-3
_BLOCK_CHARS = 300_000


@dataclass(frozen=True)
class Model:
    """A model: the buckets it knows, a weight for each, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=np.float32)
        out[self.buckets] = self.weights
        return out


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > _BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the text's number and bucket of every n-gram.  A text stands between line feeds."""
    framed = [f"\n{x.lower()}\n" for x in texts]
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, framed), dtype=np.int64, count=len(framed))
    owner = np.repeat(np.arange(len(framed), dtype=np.int32), sizes)
    for n in GRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        inside = owner[: len(h)] == owner[n - 1 :]
        yield owner[: len(h)][inside], (h[inside] & np.uint64(BUCKETS - 1)).astype(np.int64)


def occurring(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each different n-gram bucket in each text, of the wanted (by a mask) only."""
    rows, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for owner, bucket in _grams(texts):
        if wanted is not None:
            hit = wanted[bucket]
            owner, bucket = owner[hit], bucket[hit]
        rows.append(owner.astype(np.int64))
        buckets.append(bucket)
    both = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(buckets))
    return both // BUCKETS, both % BUCKETS


def scores(model_table: np.ndarray, bias: float, texts: list[str]) -> np.ndarray:
    out = []
    for block in _blocks(texts):
        rows, buckets = occurring(block, model_table != 0)
        logit = bias + np.bincount(rows, weights=model_table[buckets], minlength=len(block))
        out.append(1 / (1 + np.exp(-np.clip(logit, -40, 40))))
    return np.concatenate(out) if out else np.zeros(0)


def minimised(measure: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, steps: int = STEPS, gain: float = LEAST_GAIN, memory: int = 8) -> np.ndarray:
    """A minimum by limited-memory BFGS; ``measure`` gives value and gradient and is called about once a step."""
    value, slope = measure(at)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, held = slope.copy(), []
        for move, bend in reversed(moves):
            a = move @ direction / (move @ bend)
            held.append(a)
            direction -= a * bend
        if moves:
            direction *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1])
        else:
            direction /= max(float(np.linalg.norm(slope)), 1e-12)
        for (move, bend), a in zip(moves, reversed(held), strict=True):
            direction += (a - bend @ direction / (move @ bend)) * move
        length, downhill = 1.0, float(slope @ direction)
        while True:
            new = at - length * direction
            new_value, new_slope = measure(new)
            if new_value <= value - 1e-4 * length * downhill or length < 1e-6:
                break
            length /= 4
        if new_value >= value:
            return at
        if (new - at) @ (new_slope - slope) > 0:
            moves = [*moves, (new - at, new_slope - slope)][-memory:]
        done = value - new_value <= gain * value
        at, value, slope = new, new_value, new_slope
        if done:
            return at
    return at


def _measured(ratio: np.ndarray, weights: np.ndarray, bias: float):
    """Of rows (label, features that the text has) the logistic loss and its gradient, one row a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope, scaled = 0.0, np.zeros(len(ratio) + 1), weights * ratio
        for batch in batches:
            y, lists = batch.column(0).to_numpy(), batch.column(1)
            has, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            rows = np.repeat(np.arange(len(y)), sizes)
            logit = bias + np.bincount(rows, weights=scaled[has], minlength=len(y))
            loss += float(np.logaddexp(0, np.where(y == 1, -logit, logit)).sum())
            off = 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y
            slope[:-1] += np.bincount(has, weights=off[rows], minlength=len(ratio)) * ratio
            slope[-1] += off.sum()
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], names=["loss", "slope"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled rows (labels 0 and 1; others and null ids are left out), at most ``sample_rows`` of them.

    The sampled labels are broadcast, at most ``sample_rows`` of them; rows of equal text and label count once.  N-grams are counted and gradients summed
    by Spark.  Without labels of both kinds the model knows nothing and scores every text as the share of toxic labels (one half without
    labels); without an n-gram that differs, too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    sample = usable.orderBy(F.xxhash64("id"), "id", "y").limit(sample_rows)
    some = docs.select(F.col(id_col).alias("id"), text_column(text_col).alias("text")).join(F.broadcast(sample), "id")
    texts = written(some.groupBy("y", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")).agg(F.first("text").alias("text")).select("y", "text"), "labelled")
    total = {x["y"]: x["count"] for x in texts.groupBy("y").count().collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        share = 0.5 if not n1 + n0 else min(max(n1 / (n1 + n0), 1e-3), 1 - 1e-3)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            y, all_texts = batch.column(0).to_numpy(), strings(batch.column(1))
            done = 0
            for block in _blocks(all_texts):
                rows, buckets = occurring(block)
                for label in (0, 1):
                    found[label] += np.bincount(buckets[y[done : done + len(block)][rows] == label], minlength=BUCKETS)
                done += len(block)
        some = np.flatnonzero(found.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[0][some]), pa.array(found[1][some])], names=["bucket", "c0", "c1"])

    counts = texts.mapInArrow(count, "bucket long, c0 long, c1 long").groupBy("bucket").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    p = (F.col("c0") + F.col("c1")) / (n0 + n1)
    z = F.abs(F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + F.lit(1e-9))
    best = counts.where(z >= LEAST_Z).orderBy("bucket").toArrow()
    buckets, c0, c1 = (best.column(x).to_numpy() for x in ("bucket", "c0", "c1"))
    prior = float(np.log(n1 / n0))
    if not len(buckets):
        return Model(buckets, np.zeros(0), prior)
    ratio = np.log((c1 + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((c0 + SMOOTH) / (n0 + 2 * SMOOTH))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(BUCKETS, -1, dtype=np.int32)
        number[buckets] = np.arange(len(buckets), dtype=np.int32)
        for batch in batches:
            y, done = batch.column(0).to_numpy(), 0
            for block in _blocks(strings(batch.column(1))):
                rows, got = occurring(block, number >= 0)
                ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(block))))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(number[got]))
                yield pa.RecordBatch.from_arrays([pa.array(y[done : done + len(block)]), lists], names=["y", "has"])
                done += len(block)

    rows = written(texts.mapInArrow(present, "y int, has array<int>"), "features")

    def measure(w: np.ndarray) -> tuple[float, np.ndarray]:
        parts = rows.mapInArrow(_measured(ratio, w[:-1], float(w[-1])), "loss double, slope binary").collect()
        loss = sum(x["loss"] for x in parts) + RIDGE / 2 * float(w[:-1] @ w[:-1])
        slope = sum((np.frombuffer(x["slope"]) for x in parts), np.zeros(len(w)))
        slope[:-1] += RIDGE * w[:-1]
        return loss, slope

    w = minimised(measure, np.append(np.zeros(len(buckets)), prior))
    return Model(buckets, w[:-1] * ratio, float(w[-1]))


def score(docs: DataFrame, model: Model, *, threshold: float = 0.7, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with the score of each whole text (null and empty ones too) and whether it reaches ``threshold``, 0 or 1.

    A column that already has one of these names is replaced.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (score_col, predicted_col)]
    docs = docs.select(*keep)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    place, names = keep.index(text_col), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(table, model.bias, strings(batch.column(place))), pa.float64())], names=names)

    return docs.mapInArrow(run, schema).withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))
