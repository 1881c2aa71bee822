"""Removal of byte strings that repeat anywhere in a corpus: prefix doubling over sampled suffixes.

Plain prefix doubling ranks every byte position in every round, some sixteen bytes of shuffle for each byte
of text and round.  Here a position takes part only if some string of the threshold's length may be
repeated there:

1. *Rank by the first 128 bytes.*  Every worker gives each position the rank (a 64-bit hash) of its first 1, 2, 4 ... 128
   bytes by joining the ranks of two neighbours at growing offsets.  Of the 128-byte strings inside any string
   of threshold length, the one of the smallest rank is its anchor.  Equal strings have equal anchors at
   equal places, so only anchors (about one position in 137) are sent, each with the rank of everything that
   its strings cover.
2. *Sort and drop what is unique.*  Spark groups the anchors by rank; one with a rank of its own is done with, and anchors that
   agree in all they cover are repeated throughout.
3. *Rank by threshold length.*  Of the ranks left, one place for each different cover is sorted by rank with its surroundings, and
   the strings of threshold length that belong to it are ranked by joining the ranks of 256, 128 and 16 bytes; a string
   with a rank of its own is unique.  Ranks with more than ``HOT`` different covers are not gathered: their strings are ranked
   map-side and counted by Spark.

Identical texts are one text here, with a number of copies; with two copies all strings in it are repeated.

Repeats can be measured in words too: the same steps then go over one 64-bit hash for each word instead of the bytes, with
anchors of 16 words, and what is found is cut from the first word's first byte to the last word's last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpointed, discard, raw, release, small_batches, text_column, written

#: Covers that an anchor's rank may have and still be compared in one task, which then holds some 100 MB of string ranks.
HOT = 20_000
#: A rank with more than this share of all rows (one in so many) is broadcast to its rows instead of meeting them in one task.
CROWDED = 500
#: Bytes of the anchors' strings.
GRAM = 128
#: Words of the anchors' strings where repeats are measured in words.
WORD_GRAM = 16
#: Bytes of surroundings that a worker ranks at once, and ranked strings after which whole groups are compared.
BLOCK_BYTES, BLOCK_STRINGS = 500_000, 400_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_KEY = ["t1", "t2"]


def _byte_ranks() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * _MULT
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


_BYTES = _byte_ranks()


def _units(data: np.ndarray) -> np.ndarray:
    """Ranks of single units: of bytes those of the table, of words (hashes already) themselves."""
    return _BYTES[data] if data.dtype == np.uint8 else data


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_units(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word (whatever stands between blanks)."""
    data = np.frombuffer(text, dtype=np.uint8)
    edges = np.diff(np.concatenate(([True], _BLANK[data], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    sums, inverse = _cumulated(data)
    return mixed(mixed((sums[ends] - sums[starts]) * inverse[starts]) ^ (ends - starts).astype(np.uint64)), starts, ends


def _held(text: bytes, words: bool) -> np.ndarray:
    return word_units(text)[0] if words else np.frombuffer(text, dtype=np.uint8)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_MULT), n, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_ranks(data: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """Ranks of the strings of each length (ascending) at each position, by doubling; equal strings have equal ranks."""
    out, doubled, size = [], {1: _units(data)}, 1
    steps = {1 << b for n in lengths for b in range(n.bit_length()) if n >> b & 1}
    for length in lengths:
        while size * 2 <= length:
            r = doubled[size] if size in steps else doubled.pop(size)
            doubled[size * 2] = r[:-size] * _power(size) + r[size:] if len(r) > size else r[:0]
            size *= 2
        made, have = None, 0
        for step in sorted(doubled, reverse=True):
            if have + step <= length:
                r = doubled[step]
                if made is None:
                    made = r
                else:
                    n = max(0, len(r) - have)
                    made = made[:n] * _power(step) + r[have : have + n]
                have += step
        out.append(made)
    return out


def _window(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """Smallest or largest of each ``size`` neighbours, by doubling."""
    have = 1
    while have * 2 <= size:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def _cumulated(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of byte ranks times powers, and the inverse powers: the rank of any stretch is a difference of two sums."""
    n = len(data)
    if n + 1 > len(_POWERS[0]):
        size = 1 << (n + 1).bit_length()
        for k, base in enumerate((int(_MULT), pow(int(_MULT), -1, 1 << 64))):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_units(data) * _POWERS[0][:n], out=sums[1:])
    return sums, _POWERS[1]


_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def anchors(data: np.ndarray, threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    """Position, first bytes of the first and last string that it anchors, rank and rank of the cover, for each anchor.

    If smallest ranks tie within a string, each of them is an anchor of it.
    """
    if len(data) < threshold:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    rank = mixed(prefix_ranks(data, [gram])[0])
    span = threshold - gram + 1
    least = _window(rank, span, np.minimum)
    edge = np.zeros(span - 1, dtype=np.uint64)
    best = _window(np.concatenate((edge, least, edge)), span, np.maximum)
    at = np.flatnonzero(best == rank)
    ranks = rank[at]
    # neighbours with a smaller rank end the stretch of strings; they are anchors of the strings between them, so anchors suffice
    before, after = _smaller_neighbours(at, ranks, len(rank))
    first = np.maximum(np.maximum(at - span + 1, before + 1), 0)
    last = np.minimum(np.minimum(at, after - span), len(least) - 1)
    sums, inverse = _cumulated(data)
    cover = (sums[last + threshold] - sums[first]) * inverse[first]
    shape = ((at - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)
    return at, first, last, ranks, mixed(cover ^ mixed(shape))


def _smaller_neighbours(at: np.ndarray, ranks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest anchor before and after each one that has a smaller rank (-1 and ``size`` if there is none)."""
    before, after = np.full(len(at), -1, dtype=np.int64), np.full(len(at), size, dtype=np.int64)
    stack: list[int] = []
    values, places = ranks.tolist(), at.tolist()
    for k, value in enumerate(values):
        while stack and values[stack[-1]] > value:
            after[stack.pop()] = places[k]
        # equal ranks stay: the one below the run of equals bounds them
        j = len(stack) - 1
        while j >= 0 and values[stack[j]] == value:
            j -= 1
            if len(stack) - j > 2:  # equals share their bound
                before[k] = before[stack[-1]]
                break
        else:
            before[k] = places[stack[j]] if j >= 0 else -1
        stack.append(k)
    return before, after


def _named(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_L, _I, _B = T.LongType(), T.IntegerType(), T.BinaryType()
ANCHORS = _schema(t1=_L, t2=_L, pos=_I, first=_I, last=_I, rank=_L, cover=_L)
AROUND = _schema(t1=_L, t2=_L, pos=_I, rank=_L, begin=_I, around=_B)
FOUND = _schema(t1=_L, t2=_L, first=_I, last=_I)
HOT_ROWS = _schema(rank=_L, string=_L, t1=_L, t2=_L, first=_I)
VERDICT = _schema(t1=_L, t2=_L, n_removed=_L, spans=T.ArrayType(_schema(begin=_I, end=_I)), kept=_B)
_ARROW_AROUND = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("pos", pa.int32()), ("rank", pa.int64()), ("begin", pa.int32()), ("around", pa.binary())])
_ARROW_VERDICT = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])


def _anchor_rows(threshold: int, gram: int, words: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(k).to_numpy() for k in (0, 1))
            made = [anchors(_held(text, words), threshold, gram) for text in raw(batch.column(2))]
            if made:
                rows = np.repeat(np.arange(len(made)), [len(x[0]) for x in made])
                at, first, last, rank, cover = (np.concatenate(x) for x in zip(*made, strict=True))
                yield _named([t1[rows], t2[rows], *(x.astype(np.int32) for x in (at, first, last)), rank.view(np.int64), cover.view(np.int64)], ANCHORS.names)

    return run


def _surroundings(threshold: int, gram: int, hot: bool, words: bool = False):
    """Of each anchor given (structs of pos, rank, hot) the bytes (hashes of the words) that any string of threshold length around it can have."""
    width = 8 if words else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(k).to_pylist() for k in (0, 1))
            held, size = [], 0
            for k, (text, places) in enumerate(zip(raw(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                text = word_units(text)[0].tobytes() if words and places else text
                for place in places or ():
                    if place["hot"] != hot:
                        continue
                    pos = place["pos"]
                    begin = max(0, pos - (threshold - gram))
                    around = text[begin * width : (pos + threshold) * width]
                    held.append((t1[k], t2[k], pos, place["rank"], begin, around))
                    size += len(around)
                    if size > BLOCK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW_AROUND, strict=True)], schema=_ARROW_AROUND)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW_AROUND, strict=True)], schema=_ARROW_AROUND)

    return run


def _strings(batch: pa.RecordBatch, threshold: int, gram: int, words: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte (in its text) and rank of the strings of threshold length whose anchor is the row's position."""
    around = raw(batch.column(5))
    pos, begin = batch.column(2).to_numpy(), batch.column(4).to_numpy()
    sizes = np.fromiter(map(len, around), dtype=np.int64, count=len(around)) // (8 if words else 1)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    data = np.frombuffer(b"".join(around), dtype=np.uint64 if words else np.uint8)
    if len(data) < threshold:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, whole = prefix_ranks(data, [gram, threshold])
    least = _window(mixed(grams), threshold - gram + 1, np.minimum)
    n = np.maximum(0, np.minimum(pos - begin, sizes - threshold) + 1)  # strings from the first byte to the anchor's own
    rows = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = starts[rows] + offset
    own = least[at] == batch.column(3).to_numpy().view(np.uint64)[rows]
    rows, offset, at = rows[own], offset[own], at[own]
    return rows, begin[rows] + offset, mixed(whole[at])


def _found(t1: np.ndarray, t2: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring first bytes; the input's rows may repeat."""
    order = np.lexsort((first, t2, t1))
    t1, t2, first = t1[order], t2[order], first[order]
    same = np.concatenate(([False], (t1[1:] == t1[:-1]) & (t2[1:] == t2[:-1]) & (first[1:] - first[:-1] <= 1)))
    begins = np.flatnonzero(~same)
    ends = np.concatenate((begins[1:] - 1, [len(first) - 1]))
    return _named([t1[begins], t2[begins], first[begins].astype(np.int32), first[ends].astype(np.int32)], FOUND.names)


def _within_groups(threshold: int, gram: int, words: bool = False):
    """Rows sorted by rank: strings are ranked block by block, and of whole groups those with a common rank are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count, last = 0, None

        def compared() -> Iterator[pa.RecordBatch]:
            t1, t2, rank, first, string = (np.concatenate(x) for x in zip(*held, strict=True))
            if not len(string):
                return
            order = np.lexsort((string, rank))
            a, b = order[:-1], order[1:]
            same = (string[a] == string[b]) & (rank[a] == rank[b])
            other = same & ((t1[a] != t1[b]) | (t2[a] != t2[b]) | (first[a] != first[b]))
            # a group of equal strings counts if two of its places differ
            group = np.concatenate(([0], np.cumsum(~same)))
            good = np.zeros(group[-1] + 1, dtype=bool)
            good[group[1:][other]] = True
            kept = order[good[group]]
            if len(kept):
                yield _found(t1[kept], t2[kept], first[kept])

        step = max(1, BLOCK_BYTES // (2 * threshold * (8 if words else 1)))
        for batch in batches:
            ranks = batch.column(3).to_numpy()
            edges = np.flatnonzero(np.diff(ranks)) + 1
            at = 0
            while at < len(ranks):
                if held and count > BLOCK_STRINGS:  # go on to the end of the open group
                    stop = at if ranks[at] != last else int(edges[edges > at][0]) if (edges > at).any() else len(ranks)
                    if stop == at:
                        yield from compared()
                        held, count = [], 0
                        continue
                else:
                    stop = len(ranks)
                stop = min(stop, at + step)
                part = batch.slice(at, stop - at)
                rows, first, string = _strings(part, threshold, gram, words)
                t1, t2, rank = (part.column(k).to_numpy()[rows] for k in (0, 1, 3))
                held.append((t1, t2, rank, first.astype(np.int32), string))
                count, last, at = count + len(string), ranks[stop - 1], stop
        if held:
            yield from compared()

    return run


def _hot_rows(threshold: int, gram: int, words: bool = False):
    around = _surroundings(threshold, gram, True, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in around(batches):
            rows, first, string = _strings(batch, threshold, gram, words)
            if len(rows):
                t1, t2, rank = (batch.column(k).to_numpy()[rows] for k in (0, 1, 3))
                yield _named([rank, string.view(np.int64), t1, t2, first.astype(np.int32)], HOT_ROWS.names)

    return run


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _found(*(batch.column(k).to_numpy() for k in (0, 1, 2)))


def _cut(text: bytes, spans: list[dict]) -> bytes:
    """``text`` without its spans, which are in order and apart."""
    edges = [0, *(x for span in spans for x in (span["begin"], span["end"])), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _joined(pairs: list[tuple[int, int]]) -> list[dict]:
    """Maximal runs of stretches that overlap or touch."""
    spans: list[dict] = []
    for first, end in sorted(pairs):
        if spans and first <= spans[-1]["end"]:
            spans[-1]["end"] = max(end, spans[-1]["end"])
        else:
            spans.append({"begin": first, "end": end})
    return spans


def _verdicts(threshold: int, words: bool = False):
    """Cuts the bytes of all strings found out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(k).to_pylist() for k in (0, 1))
            rows = []
            for k, (text, found) in enumerate(zip(raw(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                pairs = [(x["first"], x["last"] + threshold) for x in found]
                if words:
                    _, starts, ends = word_units(text)
                    pairs = [(int(starts[first]), int(ends[end - 1])) for first, end in pairs]
                spans = _joined(pairs)
                kept = _cut(text, spans)
                rows.append((t1[k], t2[k], len(text) - len(kept), spans, kept))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW_VERDICT, strict=True)], schema=_ARROW_VERDICT)

    return run


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``t1, t2``, 128 bits that tell texts apart (null reads as empty)."""
    text = text_column(text_col)
    return docs.withColumn("t1", F.xxhash64(text, F.lit(1))).withColumn("t2", F.xxhash64(F.lit(2), text))


def _split(counted: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``counted`` that stand for over a ``CROWDED``-th of ``total`` rows, so fewer than ``CROWDED`` of them and broadcast, and the others."""
    crowded = F.col("rows") > total / CROWDED
    return F.broadcast(counted.where(crowded).drop("rows")), counted.where(~crowded).drop("rows")


def text_verdicts(docs: DataFrame, threshold: int = 400, *, words: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``t1, t2, n_removed, spans, kept`` of every different text (by :func:`keyed`) that loses bytes.

    A byte goes if a string of ``threshold`` bytes that covers it starts at another place too, in the same text or any other; places are
    judged on the input.  ``spans`` are the maximal runs removed and ``kept`` is what is left; both are null for texts with copies, of
    which nothing is left.  With ``words`` strings are ``threshold`` words instead, whatever blanks stand between them.  Null and short texts, and empty
    tables, lose nothing.  ``id_col`` only tells copies apart and may repeat or be null.
    """
    small_batches(docs.sparkSession)
    gram = min(WORD_GRAM if words else GRAM, threshold)
    least = 2 * threshold - 1 if words else threshold
    texts = keyed(docs.select(F.col(id_col).alias("id"), text_column(text_col).alias("text"))).where(F.octet_length("text") >= least)
    copies = texts.groupBy(*_KEY).agg(F.count("*").alias("copies"), F.min("id").alias("one"), F.min(F.octet_length("text")).cast("long").alias("n_bytes"))
    anchored = written(texts.select(*_KEY, "text").mapInArrow(_anchor_rows(threshold, gram, words), ANCHORS), "anchors")
    if words:  # a text has as many words exactly if it has an anchor
        copies = copies.join(anchored.select(*_KEY).distinct(), _KEY, "left_semi")
    copies = checkpointed(copies)
    # a hash stands for a place: 64 bits more, among the few places that share a rank
    places = anchored.withColumn("place", F.xxhash64(*_KEY, "pos"))
    several = written(places.groupBy("rank").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count("*").alias("rows")).where("a <> b").select("rank", "rows"), "ranks")
    crowd, rest = _split(several, anchored.count())
    # crowded ranks meet their places where these are; the places of the others are dealt out by rank
    places = written(places.join(crowd, "rank", "left_semi").unionByName(places.join(crowd, "rank", "left_anti").join(rest, "rank", "left_semi")), "candidates")
    discard(anchored)
    discard(several)
    release(docs.sparkSession)
    covers = checkpointed(places.groupBy("rank", "cover").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count("*").alias("rows")))
    ranks = covers.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1")
    some = written(covers.join(ranks, "rank", "left").where("a <> b or n is not null"), "covers")
    crowd, rest = _split(some, places.count())
    both = ["rank", "cover"]
    met = places.join(crowd, both).unionByName(places.join(crowd.select(*both), both, "left_anti").join(rest, both))
    shared = written(met.select(*_KEY, "pos", "first", "last", "rank", F.expr("a <> b").alias("found"), F.expr("n is not null and place = a").alias("open"), (F.col("n") > HOT).alias("hot")), "shared")
    discard(places)
    discard(some)
    release(docs.sparkSession)
    found = shared.where("found").select(*_KEY, "first", "last")
    listed = shared.where("open").groupBy(*_KEY).agg(F.collect_set(F.struct("pos", "rank", "hot")).alias("places"))
    touched = listed.join(found.select(*_KEY).distinct(), _KEY, "full").join(copies, _KEY).where("places is not null or copies = 1")
    one = (F.col("id").eqNullSafe(F.col("one"))) & (F.col("m1") == F.col("t1")) & (F.col("m2") == F.col("t2"))
    involved = written(texts.withColumnsRenamed({"t1": "m1", "t2": "m2"}).join(touched, one).select(*_KEY, "text", "places", "copies"), "involved")
    release(docs.sparkSession)
    opened = involved.where("places is not null").select(*_KEY, "text", "places")
    cool = opened.mapInArrow(_surroundings(threshold, gram, False, words), AROUND)
    within = cool.repartition("rank").sortWithinPartitions("rank").mapInArrow(_within_groups(threshold, gram, words), FOUND)
    strings = opened.where(F.exists("places", lambda x: x["hot"])).mapInArrow(_hot_rows(threshold, gram, words), HOT_ROWS)
    start = F.struct(*_KEY, "first")
    again = checkpointed(strings.groupBy("rank", "string").agg(F.min(start).alias("a"), F.max(start).alias("b")).where("a <> b").select("rank", "string"))
    hot = strings.join(again, ["rank", "string"]).select(*_KEY, "first").mapInArrow(_runs_of, FOUND)
    spans = found.unionByName(within).unionByName(hot).groupBy(*_KEY).agg(F.collect_set(F.struct("first", "last")).alias("found"))
    cut = involved.where("copies = 1").dropDuplicates(_KEY).select(*_KEY, "text").join(spans, _KEY).select(*_KEY, "text", "found").mapInArrow(_verdicts(threshold, words), VERDICT)
    nothing = copies.where("copies > 1").select(*_KEY, F.col("n_bytes").alias("n_removed"), F.lit(None).cast(VERDICT["spans"].dataType).alias("spans"), F.lit(None).cast("binary").alias("kept"))
    return cut.unionByName(nothing)


def remove_repeats(docs: DataFrame, threshold: int = 400, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text, and ``n_removed`` (see :func:`text_verdicts`).

    All rows stay, texts may become empty, null texts stay null; of a character that a cut splits nothing is kept.  A column ``n_removed`` is replaced.
    """
    return _shortened(docs, [(threshold, False)], id_col, text_col)


def remove_passages(docs: DataFrame, threshold: int = 400, words: int = 51, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`remove_repeats` for strings of ``threshold`` bytes and for those of ``words`` words, whichever a repeat reaches; both are judged on the input."""
    return _shortened(docs, [(threshold, False), (words, True)], id_col, text_col)


def _shortened(docs: DataFrame, rules: list[tuple[int, bool]], id_col: str, text_col: str) -> DataFrame:
    found = None
    for size, by_words in rules:
        told = text_verdicts(docs, size, words=by_words, id_col=id_col, text_col=text_col)
        table = written(told.select(F.col("t1").alias("__v1"), F.col("t2").alias("__v2"), "spans"), "verdicts")
        release(docs.sparkSession)
        found = table if found is None else found.unionByName(table)
    v = found.groupBy("__v1", "__v2").agg(F.bool_or(F.col("spans").isNull()).alias("__all"), F.flatten(F.collect_list("spans")).alias("__spans"))
    docs = docs.drop("n_removed")
    text = text_column(text_col)
    keys = docs.withColumn(text_col, F.col(text_col).cast("string")).withColumn("__t1", F.xxhash64(text, F.lit(1))).withColumn("__t2", F.xxhash64(F.lit(2), text))
    joined = keys.join(v, (F.col("__t1") == F.col("__v1")) & (F.col("__t2") == F.col("__v2")), "left").select(*docs.columns, "__all", "__spans")
    place, width = docs.columns.index(text_col), len(docs.columns)
    schema = T.StructType([*joined.schema.fields[:width], T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = batch.column(place).is_valid().to_pylist()
            texts, gone = raw(batch.column(place)), []
            for k, (whole, spans) in enumerate(zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True)):
                before = texts[k]
                if whole is not None:
                    kept = b"" if whole else _cut(before, _joined([(x["begin"], x["end"]) for x in spans]))
                    texts[k] = kept.decode("utf-8", "ignore").encode()
                    gone.append(len(before) - len(kept))
                else:
                    gone.append(0)
            left = pa.array([x if there else None for x, there in zip(texts, valid, strict=True)], pa.binary()).cast(pa.string())
            columns = [left if k == place else batch.column(k) for k in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)
