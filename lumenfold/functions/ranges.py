"""Positional selection from ordered arrays, in the five dialects that consumers use.

``strict`` (bounds are errors, positions from 1), ``clamped`` (bounds are clamped, positions from 0), ``single`` (one position
only), ``pairs`` (all or all but the last) and ``steps`` (every summary or the last).
Out-of-range selections are null with a message in ``range_error``; specifications that no row could satisfy fail at once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT, CLAMPED, SINGLE, PAIRS, STEPS = "strict", "clamped", "single", "pairs", "steps"
JOINER = {STRICT: "\n", CLAMPED: "\n\n", SINGLE: "\n\n"}


class RangeError(ValueError):
    """A specification that is not of the dialect."""


def _bounds(spec: str) -> tuple[int, int] | None:
    if m := re.fullmatch(r"(-?\d+)", spec):
        return int(m[1]), int(m[1])
    if m := re.fullmatch(r"(\d+)-(\d+)", spec):
        return int(m[1]), int(m[2])
    return None


def positions(array: Column, spec: str, dialect: str = STRICT) -> Column:
    """The selected positions from 1, as an array of ints; null if the specification doesn't fit the row."""
    n = F.size(array)
    every = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    one, none, last = F.lit(1), F.lit(None).cast("array<int>"), F.array(n)
    first = F.array(one)
    if dialect == PAIRS:
        if spec == "all":
            return every(one, n)
        if spec == "all-but-last":
            return F.when(n > 1, every(one, n - 1))
        raise RangeError(f"{spec!r} is not a range of the dialect {dialect}")
    if dialect == STEPS:
        return F.when(n > 0, last) if spec == "last" else every(one, n)
    if dialect not in (STRICT, CLAMPED, SINGLE):
        raise RangeError(f"unknown dialect {dialect!r}")
    held = n > 0
    if spec == "all":
        return F.when(held, last if dialect == SINGLE else every(one, n))
    if spec == "last":
        return F.when(held, last)
    if spec == "penultimate":
        few = none if dialect == STRICT else F.when(held, first)
        return F.when(n >= 2, F.array(n - 1)).otherwise(few)
    if spec == "all-but-last":
        few = none if dialect == STRICT else F.when(held, first)
        return F.when(n >= 2, F.array(n - 1) if dialect == SINGLE else every(one, n - 1)).otherwise(few)
    if (found := _bounds(spec)) is None:
        raise RangeError(f"{spec!r} is not a range")
    a, b = found
    if "-" not in spec[1:]:
        return F.when((n >= a) & (F.lit(a) >= 1), F.array(F.lit(a)))
    if dialect == SINGLE:
        return F.when((n >= b) & (F.lit(b) >= 1), F.array(F.lit(b)))
    if dialect == STRICT:
        return F.when((F.lit(a) >= 1) & (F.lit(a) <= b) & (n >= b), every(F.lit(a), F.lit(b)))
    low, high = F.greatest(F.lit(a), one), F.least(F.lit(b), n)
    return F.when(held & (low <= high), every(low, high))


def select_range(array: str | Column, spec: str, dialect: str = STRICT) -> Column:
    """``struct<text, positions, range_error>``: the selected elements joined as the dialect joins them; positions as it counts them."""
    array = F.col(array) if isinstance(array, str) else array
    at = positions(array, spec, dialect)
    shift = 0 if dialect in (STRICT, PAIRS, STEPS) else 1
    text = F.array_join(F.transform(at, lambda p: F.get(array, p - 1)), JOINER.get(dialect, "\n\n"))
    return F.struct(F.when(at.isNotNull(), text).alias("text"), F.transform(at, lambda p: p - shift).alias("positions"), F.when(at.isNull(), F.lit(f"range {spec} is out of bounds")).alias("range_error"))


def parse_document_range(spec: str) -> list[int]:
    """Document numbers from 0 of ``a-b`` (both ends), ``a,b,c`` (sorted, each once) or ``a``."""
    spec = spec.strip()
    if m := re.fullmatch(r"(\d+)\s*-\s*(\d+)", spec):
        a, b = int(m[1]), int(m[2])
        if a > b:
            raise RangeError(f"{spec!r} ends before it starts")
        return list(range(a, b + 1))
    if re.fullmatch(r"\d+(\s*,\s*\d+)*", spec):
        return sorted({int(x) for x in spec.split(",")})
    raise RangeError(f"{spec!r} is not a document range")


def documents_in(documents: str | Column, spec: str) -> Column:
    """The documents of those numbers; numbers beyond the array select nothing."""
    wanted = F.array(*map(F.lit, parse_document_range(spec)))
    return F.filter(documents, lambda _, i: F.array_contains(wanted, i))


def expanded(array: str | Column, most: int | None = None) -> Column:
    """1 to the number of elements (at most ``most``): one job for every range of every item."""
    n = F.size(array)
    top = n if most is None else F.least(n, F.lit(most))
    return F.when(top > 0, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>"))
