"""Which texts hold which terms: a join on anchors, for any number of terms of any length.

A term of n bytes is cut to its first 2**j bytes, the most that fit in n; its anchor is the string of half that length (all of it up to 8 bytes) with the
smallest hash in there.  A text that holds the term holds these 2**j bytes, and so has the same anchor among those of its windows of that size, of which
neighbours mostly share theirs: a text has about 4 anchors for each 2**j bytes and size in use.  Texts and terms meet by anchor, with their hashes only.
The pairs that met are verified: each text is joined back once for every thousand of its candidates, and searched for these.

Anchors are numpy in Arrow batches, all else is joins and grouping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import folder, saved

#: Candidates that a text is searched for at once.
TOGETHER = 1_000
#: Up to this many bytes a term is its own anchor, cut to a power of two.
SHORT = 8
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` (a power of two) bytes from each byte on, by doubling."""
    ranks, have = _mixed(data.astype(np.uint64) + np.uint64(1)), 1
    while have < size:
        power = np.uint64(pow(int(_MULT), have, 1 << 64))
        ranks = ranks[:-have] * power + ranks[have:] if len(ranks) > have else ranks[:0]
        have *= 2
    return _mixed(ranks ^ np.uint64(size))


def least_of(x: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each ``size`` neighbours."""
    have = 1
    while have * 2 <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def anchors(data: np.ndarray, level: int) -> np.ndarray:
    """The anchor of each window of ``2**level`` bytes."""
    size = 1 << level
    if len(data) < size:
        return np.zeros(0, dtype=np.uint64)
    half = size if size <= SHORT else size // 2
    return least_of(string_hashes(data, half), size - half + 1)


def keyed(rows: DataFrame, text: str, first: str, second: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with 128 bits that tell texts (of a scope) apart."""
    return rows.withColumn(first, F.xxhash64(text, F.lit(1), *by)).withColumn(second, F.xxhash64(F.lit(2), F.col(text), *by))


def _raw(column_: pa.Array) -> list[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(column_.type) else pa.binary()
    return column_.cast(kind).to_pylist()


def _of_texts(levels: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = []
                for text in _raw(part.column(2)):
                    data = np.frombuffer(text, dtype=np.uint8)
                    found.append(np.unique(np.concatenate([anchors(data, level) for level in levels])))
                rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
                same = (pa.array(part.column(k).to_numpy()[rows]) for k in (0, 1, 3))
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.concatenate(found).view(np.int64))], names=["t1", "t2", "s", "anchor"])

    return run


def _of_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [int(anchors(np.frombuffer(x[: 1 << (len(x).bit_length() - 1)], dtype=np.uint8), len(x).bit_length() - 1)[0].view(np.int64)) for x in _raw(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(made, pa.int64())], names=["o1", "o2", "s", "anchor"])


def candidates(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``t1, t2, o1, o2`` of texts (``t1, t2, text, s``) and terms (``o1, o2, term, s``, none empty) of one scope ``s`` that share an anchor."""
    levels = [x[0] for x in terms.select(F.floor(F.log2(F.octet_length("term") + 0.5)).cast("int").alias("level")).distinct().collect()]  # 31 at most
    own = texts.select("t1", "t2", "text", "s").mapInArrow(_of_texts(sorted(levels) or [0]), "t1 long, t2 long, s long, anchor long")
    of = terms.select("o1", "o2", "term", "s").mapInArrow(_of_terms, "o1 long, o2 long, s long, anchor long")
    return own.join(of, ["s", "anchor"]).select("t1", "t2", "o1", "o2").distinct()


def pairs(rows: DataFrame, others: DataFrame, text: str, other: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``t1, t2, o1, o2, term`` for each different text of ``rows`` and term of ``others`` that it holds; texts are named by their hashes (:func:`keyed`).

    With ``by`` (columns of both) texts meet terms of their own scope only.  Null texts hold nothing, empty and null terms are in nothing; a text holds itself.
    """
    path, scope = folder(rows.sparkSession, "containment"), F.xxhash64(*by) if by else F.lit(0).cast("long")
    texts = keyed(rows.where(F.col(text).isNotNull()), text, "t1", "t2", by).select("t1", "t2", F.col(text).alias("text"), scope.alias("s"))
    terms = keyed(others.where(F.col(other) != ""), other, "o1", "o2", by).select("o1", "o2", F.col(other).alias("term"), scope.alias("s")).dropDuplicates(["o1", "o2"])
    met = saved(candidates(texts, terms), f"{path}/candidates")
    shares = met.groupBy("t1", "t2").agg(F.ceil(F.count("*") / TOGETHER).alias("shares"))
    dealt = met.join(shares, ["t1", "t2"]).withColumn("share", F.pmod(F.xxhash64("o1"), F.col("shares")))
    asked = dealt.join(terms.drop("s"), ["o1", "o2"]).groupBy("t1", "t2", "share").agg(F.collect_list(F.struct("o1", "o2", "term")).alias("terms"))
    searched = texts.dropDuplicates(["t1", "t2"]).join(asked, ["t1", "t2"])
    held = F.filter("terms", lambda x: F.contains("text", x["term"]))
    return searched.select("t1", "t2", F.explode(held).alias("x")).select("t1", "t2", "x.*")


def contained_in(rows: DataFrame, others: DataFrame, text: str, other: str, *, by: tuple[str, ...] = (), either_way: bool = False, anti: bool = False) -> DataFrame:
    """Rows whose text holds some other text (or is held by one with ``either_way``), of its scope if there are columns ``by``; with ``anti`` those that hold none.

    Any number of texts of any length on both sides.  Empty texts of ``others`` are in no text, null texts hold none and are in none.
    """
    hit = pairs(rows, others, text, other, by).select("t1", "t2")
    if either_way:
        hit = hit.unionByName(pairs(others, rows, other, text, by).select(F.col("o1").alias("t1"), F.col("o2").alias("t2")))
    known = hit.distinct().select(F.col("t1").alias("__h1"), F.col("t2").alias("__h2"))
    own = keyed(rows, text, "__t1", "__t2", by)
    return own.join(known, (F.col("__t1") == F.col("__h1")) & (F.col("__t2") == F.col("__h2")) & F.col(text).isNotNull(), "left_anti" if anti else "left_semi").select(*rows.columns)
