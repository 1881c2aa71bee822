"""Compression of vectors to codes: a codebook for each part, found by Lloyd's rounds with Yinyang bounds.

Vectors of whole numbers are cut into equal parts, and each part of a vector is coded by the nearest entry of that part's codebook.
The entries of a codebook are clustered into groups once.  Every part of every vector keeps its entry, an upper bound of
the distance to it and one lower bound for each group; when entries have moved, the bounds move by as much, and only
the groups whose lower bound then fails are scanned.  Bounds are rounded outwards and distances compared as
integers, so the result is that of full scans, ties to the lower index.

A round is one pass over a table of bytes with the state beside the vector; each task adds up its parts by entry and Spark sums these
rows, as many as the codebooks have components, which is all that reaches the driver.  Each round's table is written, so a lost executor repeats its tasks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import discard, small_batches, written
from ._vectors import binary, matrix, packed

#: Relative and absolute widening of bounds, far beyond the rounding of their sums.
SLACK = 1e-5
_MOST = np.iinfo(np.int64).max
#: Squared distances computed at once.
_BLOCK = 1 << 18


def grouped(book: np.ndarray, groups: int) -> list[np.ndarray]:
    """The entries of a codebook in at most ``groups`` groups of near ones: a few rounds of Lloyd's over the entries."""
    centres = book[np.linspace(0, len(book) - 1, min(groups, len(book))).astype(int)].astype(float)
    for _ in range(5):
        near = ((book[:, None, :] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([book[near == g].mean(0) if (near == g).any() else centres[g] for g in range(len(centres))])
    return [np.flatnonzero(near == g) for g in range(len(centres)) if (near == g).any()]


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, as integers."""
    out = np.empty((len(x), len(book)), dtype=np.int64)
    step = max(1, _BLOCK // max(1, book.size))
    for at in range(0, len(x), step):
        gap = x[at : at + step, None, :] - book
        out[at : at + step] = np.einsum("ijk,ijk->ij", gap, gap)
    return out


def _own(x: np.ndarray, book: np.ndarray, a: np.ndarray) -> np.ndarray:
    gap = x - book[a]
    return np.einsum("ij,ij->i", gap, gap)


def reassign(x: np.ndarray, book: np.ndarray, groups: list[np.ndarray], moved: np.ndarray | None, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Brings entries and bounds of the rows ``x`` up to date with ``book``; the number of distances computed.

    ``moved`` has how far each entry went since the bounds held; None if there are none yet.
    """
    if not len(x):
        return 0
    count = 0
    if moved is None:
        rows = np.arange(len(x))
        exact = np.full(len(x), _MOST)
        a[:] = len(book)
        lower[:] = -np.inf
    else:
        upper += moved[a]
        lower -= np.array([moved[g].max() for g in groups])
        rows = np.flatnonzero(lower.min(1) <= upper * (1 + SLACK) + SLACK)
        exact = _own(x[rows], book, a[rows])
        upper[rows] = np.sqrt(exact)
        count += len(rows)
        open_ = lower[rows].min(1) <= upper[rows] * (1 + SLACK) + SLACK
        rows, exact = rows[open_], exact[open_]
    best, who, old = exact.copy(), a[rows].astype(np.int64), a[rows].astype(np.int64)
    nearest = np.full((len(rows), len(groups)), -1)
    first, second = np.full(nearest.shape, _MOST), np.full(nearest.shape, _MOST)
    for g, members in enumerate(groups):
        need = np.flatnonzero(lower[rows, g] <= np.sqrt(best) * (1 + SLACK) + SLACK)
        if not len(need):
            continue
        d = _squares(x[rows[need]], book[members])
        count += d.size
        d[members == old[need, None]] = _MOST
        order = np.argsort(d, axis=1, kind="stable")[:, :2]
        at = np.arange(len(need))
        one, entry = d[at, order[:, 0]], members[order[:, 0]]
        nearest[need, g], first[need, g] = entry, one
        if order.shape[1] > 1:
            second[need, g] = d[at, order[:, 1]]
        better = (one < best[need]) | ((one == best[need]) & (entry < who[need]))
        best[need[better]], who[need[better]] = one[better], entry[better]
    scanned = nearest >= 0
    bound = np.sqrt(np.where(nearest == who[:, None], second, first))
    fresh = lower[rows]
    fresh[scanned] = bound[scanned]
    if moved is not None:  # an entry given up bounds its group from now on
        group_of = np.zeros(len(book), dtype=np.int64)
        for g, members in enumerate(groups):
            group_of[members] = g
        gone = np.flatnonzero(who != old)
        fresh[gone, group_of[old[gone]]] = np.minimum(fresh[gone, group_of[old[gone]]], np.sqrt(exact[gone]))
    lower[rows], a[rows], upper[rows] = fresh, who, np.sqrt(best)
    return count


def _state(parts: int, groups: int) -> np.dtype:
    return np.dtype([("a", "u1", (parts,)), ("upper", "<f4", (parts,)), ("lower", "<f4", (parts, groups))])


def _outwards(x: np.ndarray, to: float) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(to))


def _assigning(books: np.ndarray, groups: list[list[np.ndarray]], moved: np.ndarray | None, most: int, schema: T.StructType):
    """One round over rows of (..., vector, state, sums): new states, and in the end a row of the task's sums alone."""
    parts, entries, width = books.shape
    kind = _state(parts, most)
    nulls = [f.name for f in schema.fields[:-3]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, computed, names = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64), 0, None
        for batch in batches:
            n = len(nulls)
            names = names or batch.schema
            x = matrix(batch.column(n), parts * width).astype(np.int64).reshape(-1, parts, width)
            state = np.zeros(len(x), kind) if moved is None else np.frombuffer(b"".join(batch.column(n + 1).to_pylist()), dtype=kind).copy()
            for p in range(parts):
                a, upper = state["a"][:, p].astype(np.int64), state["upper"][:, p].astype(float)
                lower = state["lower"][:, p, : len(groups[p])].astype(float)
                computed += reassign(x[:, p], books[p], groups[p], None if moved is None else moved[p], a, upper, lower)
                state["a"][:, p], state["upper"][:, p] = a, _outwards(upper, np.inf)
                state["lower"][:, p, : len(groups[p])] = _outwards(lower, -np.inf)
                np.add.at(sums[p], a, x[:, p])
                counts[p] += np.bincount(a, minlength=entries)
            rows = [*(batch.column(k) for k in range(n + 1)), binary(state), pa.nulls(len(x), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(rows, names=schema.names)
        if names is not None:
            told = pa.array([np.concatenate((sums.ravel(), counts.ravel(), [computed])).tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, names.field(k).type) for k in range(len(nulls) + 1)), pa.nulls(1, pa.binary()), told], names=schema.names)

    return run


def _coded(books: np.ndarray, most: int, keep: int, schema: T.StructType):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(keep), parts * width).astype(np.int64).reshape(-1, parts, width)
            a = np.frombuffer(b"".join(batch.column(keep + 1).to_pylist()), dtype=_state(parts, most))["a"]
            error = sum((_own(x[:, p], books[p], a[:, p]) for p in range(parts)), np.zeros(len(x), np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(keep)), pa.array([row.tobytes().hex() for row in a], pa.string()), pa.array(error)], names=schema.names)

    return run


def compress(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, groups: int = 4, id_col: str = "vec_id", vector_col: str = "v") -> tuple[DataFrame, np.ndarray, list[int]]:
    """``vectors`` without the vector but with ``code`` and ``error``, the codebooks (part, entry, component), and the distances computed in each round.

    ``vector_col`` holds arrays of longs (``_vectors.whole_numbers``); rows where it is null or empty go.  Codebooks start as the parts of the
    rows of the ``entries`` smallest ids (all, if fewer; null ids last; equal ids by vector).  All rows count, ids that repeat too.  The first of these rows gives
    the number of components; rows of another number go.  If ``parts`` doesn't divide it, zeros are added to every vector, which no distance sees.  An entry
    without rows stays.  ``code`` has two hex digits a part, ``error`` is the squared distance.  Columns named ``code`` or ``error`` are replaced.  Without
    rows there are no codes and the codebooks are empty.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index is one byte: entries must be 1 to 256")
    small_batches(vectors.sparkSession, 10_000)
    kept = [c for c in vectors.columns if c not in (vector_col, "code", "error")]
    rows = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    inner = rows.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(kept)], F.col(vector_col).alias("v"))
    own = inner[f"c{kept.index(id_col)}"]
    seeds = [x.v for x in inner.select("v", own.alias("id")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    schema = T.StructType([*inner.schema.fields[:-1], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    back = [F.col(f"c{k}").alias(c) for k, c in enumerate(kept)]
    if not seeds:
        return inner.select(*inner.columns[:-1], F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0).select(*back, "code", "error"), np.zeros((parts, 0, 0), np.int64), []
    dim = len(seeds[0])
    width = -(-dim // parts)
    more = F.array_repeat(F.lit(0).cast("long"), parts * width - dim)
    data = packed(inner.where(F.size("v") == dim).withColumn("v", F.concat("v", more)), "v")
    start = np.array([s + [0] * (parts * width - dim) for s in seeds if len(s) == dim], dtype=np.int64)
    books = start.reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    near = [grouped(book, groups) for book in books]
    most = max(map(len, near))
    # a task's row of sums has nulls elsewhere
    full = T.StructType([*(T.StructField(f.name, f.dataType) for f in data.schema.fields), T.StructField("state", T.BinaryType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    table = written(data.select("*", F.lit(None).cast("binary").alias("state"), F.lit(None).cast("array<bigint>").alias("sums")), "vectors")
    moved, computed = None, []
    for step in range(rounds + 1):
        made = written(table.where("sums is null").mapInArrow(_assigning(books, near, moved, most, full), full), "assigned")
        discard(table)
        table = made
        cells = table.where("sums is not null").select(F.posexplode("sums").alias("cell", "x")).groupBy("cell").agg(F.sum("x").alias("x"))
        told = np.zeros(books.size + books[..., 0].size + 1, dtype=np.int64)
        for x in cells.collect():  # as many as the codebooks have components
            told[x.cell] = x.x
        computed.append(int(told[-1]))
        if step < rounds:
            sums, counts = told[: books.size].reshape(books.shape), told[books.size : -1].reshape(books.shape[:2])
            fresh = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
            moved = np.sqrt(((fresh - books).astype(float) ** 2).sum(2)) * (1 + SLACK)
            books = fresh
    coded = table.where("sums is null").mapInArrow(_coded(books, most, len(kept), schema), schema)
    return coded.select(*back, "code", "error"), books, computed


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in order, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
