"""Best-two-fit packing of token pieces into fixed-length sequences.

Token ids are made map-side; only lengths decide the packing, so pieces travel without their ids.
Pieces are dealt into buckets of bounded size by a hash of document and piece, and each bucket is packed
alone.  A bucket wastes at most about one sequence, so with tens of thousands of pieces in it the result is
as tight as packing everything at once, and no task ever holds more than a bucket.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpointed, small_batches, strings
from .bpe import read_ranks

#: Pieces aimed at in a bucket.
BUCKET_PIECES = 50_000
PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """Added tokens of a tokenizers file with their ids.  Only such that stand for exactly their own text are known here."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    added = whole.get("added_tokens") or []
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] or (x["normalized"] and whole.get("normalizer")) for x in added):
        raise ValueError("added tokens that take in or depend on their surroundings")
    return tuple((x["content"], x["id"]) for x in added)


@lru_cache(maxsize=2)
def rank_codec(path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    """The rank-file form of a vocabulary; with the added tokens of the tokenizers file ``encode(text, allowed_special="all")`` gives that file's ids (tested), several times faster."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens=dict(added))


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, *, added: tuple[tuple[str, int], ...] = (), capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids`` of each document's token pieces.

    ``added`` are the tokens beyond the rank file (see :func:`added_tokens`), single ids wherever a text holds them.  A document is its ids and then ``end_id``; one longer than ``capacity`` is cut into pieces of exactly ``capacity``
    after a first piece that takes what is left over.  Null and empty texts are the end id alone.  Null ids stay null,
    repeated rows are documents of their own, other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = rank_codec(ranks_path, pattern, added), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                ids = np.asarray(codec.encode(text, allowed_special="all"), dtype="<u4").tobytes() + end
                total = len(ids) // 4
                cuts = [0, *range(total % capacity or capacity, total, capacity), total]
                for k, (begin, stop) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip(rows, (doc, k, begin, stop - begin, ids[4 * begin : 4 * stop]), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=PIECES.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to ``capacity``).

    A bin takes the longest piece left that fits, again and again.  If a gap remains, its smallest piece is replaced by
    the two unpacked pieces that fit the gap and its own place most tightly, if they fill more than it did.
    """
    by_length: list[list[int]] = [[] for _ in range(capacity + 1)]
    for k in np.argsort(lengths, kind="stable")[::-1].tolist():
        by_length[int(lengths[k])].append(k)
    count = np.array([len(x) for x in by_length])
    below = np.zeros(capacity + 1, dtype=np.int64)  # longest length at hand that is no more than the index

    def refresh() -> None:
        np.maximum.accumulate(np.where(count > 0, np.arange(capacity + 1), 0), out=below)

    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    number, left = 0, len(lengths)
    refresh()
    while left:
        gap, held = capacity, []
        while gap and (take := int(below[gap])):
            held.append(take)
            gap -= take
            count[take] -= 1
            if not count[take]:
                refresh()
        if gap and len(held) > 1:
            room = gap + held[-1]
            small = np.arange(1, room // 2 + 1)
            small = small[count[small] > 0]
            if len(small):
                large = below[room - small]
                # the two may be of one length only if it is there twice
                large = np.where((large == small) & (count[small] < 2), 0, large)
                both = np.where((large >= small) & (large > 0), small + large, 0)
                best = int(np.argmax(both))
                if both[best] > held[-1]:
                    back = held.pop()
                    count[back] += 1
                    held += [int(large[best]), int(small[best])]
                    for x in held[-2:]:
                        count[x] -= 1
                    refresh()
        place = 0
        for x in held:
            k = by_length[x].pop()
            bins[k], offsets[k] = number, place
            place += x
        left -= len(held)
        number += 1
    return bins, offsets


def pack(pieces: DataFrame, *, capacity: int = 1024, length_col: str = "length", salt: list[str | Column] | None = None) -> DataFrame:
    """Adds ``sequence_id`` (unique numbers, not dense) and ``offset`` to rows with lengths from 1 to ``capacity``.

    Rows are dealt into buckets by their places in a checkpoint, so repeated rows and null ids spread like all others, and a lost task deals them
    again as before.  ``salt`` names columns to deal by instead; rows that agree in all of them share a bucket, so they must not have hot values.
    Empty input gives an empty result, ties go to any order, other columns pass through (older ones of these two names are replaced).
    Rows with a null length or one out of range are in no sequence: both new columns are null.
    """
    spark = pieces.sparkSession
    small_batches(spark, 10_000)
    pieces = checkpointed(pieces.drop("sequence_id", "offset", "__bucket"))  # counted and then dealt out: made once
    total = pieces.count()
    buckets = max(1, round(total / BUCKET_PIECES))
    salt = salt if salt is not None else [F.monotonically_increasing_id()]
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    place, names = pieces.columns.index(length_col), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket, sent = [], None, 0

        def packed() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            for batch in whole:
                lengths = batch.column(place).cast(pa.int64()).fill_null(0).to_numpy()
                held_back = (lengths < 1) | (lengths > capacity)
                bins, offsets = np.zeros((2, len(lengths)), dtype=np.int64)
                bins[~held_back], offsets[~held_back] = best_two_fit(lengths[~held_back], capacity)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 2], pa.array(bins * buckets + bucket, mask=held_back), pa.array(offsets, mask=held_back)], names=names)

        for batch in batches:
            keys = batch.column(len(names) - 2).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for begin, end in zip(edges, edges[1:], strict=False):
                if begin == end:
                    continue
                if bucket is not None and keys[begin] != bucket:
                    yield from packed()
                    held = []
                bucket = int(keys[begin])
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from packed()

    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*salt), F.lit(buckets)).cast("long"))
    dealt = dealt.repartition(buckets, "__bucket").sortWithinPartitions("__bucket")
    return dealt.mapInArrow(run, schema)
