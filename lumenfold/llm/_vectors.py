"""Vectors of whole numbers, as rows of bytes that numpy reads without a copy for each value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import raw

#: Components reach at most this size: squared distances of up to 512 components then fit 64 bits.
LARGEST = 1 << 26


def whole_numbers(column: str | Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector or a component is null or not finite.

    A vector with a component over ``LARGEST`` (x over 2**26 / scale) counts as not finite: its distances wouldn't fit 64 bits.
    """
    v = F.col(column) if isinstance(column, str) else column
    wide = F.transform(v, lambda x: x.cast("double") * scale)
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST))
    return F.when(v.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(wide, lambda x: F.floor(x)))


def flat(column: pa.Array) -> np.ndarray:
    """All values of a column of arrays of longs, one row after the other."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def matrix(column: pa.Array, width: int, kind: str = "<i4") -> np.ndarray:
    """The rows of a binary column, each ``width`` values."""
    return np.frombuffer(b"".join(raw(column)), dtype=kind).reshape(len(column), width)


def binary(rows: np.ndarray) -> pa.Array:
    """A binary column with the bytes of each row."""
    data = np.ascontiguousarray(rows)
    size = data.nbytes // max(1, len(data))
    offsets = np.arange(len(data) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def packed(rows: DataFrame, vector_col: str) -> DataFrame:
    """``rows`` with the arrays of longs in ``vector_col`` (none null) as bytes, four for each component."""
    place, width = rows.columns.index(vector_col), len(rows.columns)
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if k == place else f for k, f in enumerate(rows.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = flat(column).astype("<i4")
            if len(set(sizes.tolist())) == 1:
                made = binary(values.reshape(len(sizes), -1))
            else:
                ends = np.cumsum(sizes)
                made = pa.array([values[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([made if k == place else batch.column(k) for k in range(width)], names=schema.names)

    return rows.mapInArrow(run, schema)
