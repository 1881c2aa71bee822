"""Pairs of alike short strings within a scope: a similarity join, not all pairs.

Two strings whose longest common subsequence has a share of ``t`` of both lengths (twice its length over their sum) have at least that many characters in common, counted with
repeats.  So each string is the set of its characters numbered by occurrence, ordered from rare to frequent, and strings that are alike must share two
of their first few (one, where strings are long or tiny).  Strings are joined by these pairs of rare characters; what meets is checked by length and by characters in
common, all in the JVM, and only then are subsequences compared, 64 characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import folder, saved
from .overlap import lcs_length

#: Strings up to this length meet by two characters; longer ones would have too many pairs of them.
TWO = 40


@F.pandas_udf(T.DoubleType())
def subsequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the longest common subsequence over both lengths; 1 for two empty strings."""
    for a, b in batches:
        yield pd.Series([2 * lcs_length(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(a, b, strict=True)], dtype=float)


def numbered(text: str | Column) -> Column:
    """The characters of a string, each with the number of its occurrence."""
    t = F.col(text) if isinstance(text, str) else text
    sort = F.array_sort(F.filter(F.split(t, ""), lambda c: c != ""))
    of = lambda chars: F.transform(chars, lambda c, i: F.concat(c, (i - F.array_position(chars, c)).cast("string")))
    return F.get(F.transform(F.array(sort), of), F.lit(0))


def _ordered(names: DataFrame, by: list[str]) -> DataFrame:
    """``by, x, tokens`` of different strings, tokens from rare to frequent."""
    each = names.select(*by, "x", F.explode(numbered("x")).alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("often"))
    sets = each.join(often, "token").groupBy(*by, "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "token"))), lambda s: s["token"]).alias("tokens"))
    empty = names.where("x = ''").select(*by, "x", F.array().cast("array<string>").alias("tokens"))
    return sets.unionByName(empty)


def _keys(similar: float) -> Column:
    """What strings (of ``tokens``) that may be alike have in common."""
    n, r = F.size("tokens"), similar / (2 - similar)  # a partner has at least r and at most 1 / r times the length
    shared = F.ceil(n * r - 1e-9)
    first = F.slice("tokens", 1, F.greatest(n - shared + 1, F.lit(1)).cast("int"))
    more = F.slice("tokens", 1, F.greatest(n - shared + 2, F.lit(1)).cast("int"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(more)), lambda i: F.transform(F.slice(more, i + 1, F.size(more)), lambda y: F.concat(F.lit("2"), F.get(more, i - 1), F.lit("|"), y))))
    none = F.array().cast("array<string>")
    ones = F.when((n / r > TWO) | (shared < 2), F.transform(first, lambda x: F.concat(F.lit("1"), x))).otherwise(none)
    return F.when(n == 0, F.array(F.lit("0"))).otherwise(F.concat(ones, F.when(n <= TWO, pairs).otherwise(none)))


def pairs(left: DataFrame, right: DataFrame, *, by: list[str], a: str, b: str, similar: float) -> DataFrame:
    """``by, a, b, ratio`` of the different strings of ``left`` and ``right`` (of one scope ``by``) whose ratio (:func:`subsequence_ratio`) is ``similar`` or more.

    ``similar`` is over 0 and at most 1.  Null strings and scopes have no pairs; two empty strings are alike.  Strings are names or sentences: the number of keys grows
    with the square of the length up to ``TWO`` characters and with the length beyond.
    """
    path = folder(left.sparkSession, "alike")
    sides = [rows.where(F.col(name).isNotNull()).select(*by, F.col(name).alias("x"), F.lit(side).alias("side")) for rows, name, side in ((left, a, 0), (right, b, 1))]
    both = sides[0].unionByName(sides[1]).groupBy(*by, "x").agg(F.collect_set("side").alias("sides"))
    known = saved(_ordered(both, by), f"{path}/ordered").join(both, [*by, "x"])
    keyed = saved(known.select(*by, "x", "tokens", "sides", F.explode(_keys(similar)).alias("key")), f"{path}/keyed")
    one = keyed.where(F.array_contains("sides", 0)).select(*by, "key", F.col("x").alias("a"), F.col("tokens").alias("__a"))
    two = keyed.where(F.array_contains("sides", 1)).select(*by, "key", F.col("x").alias("b"), F.col("tokens").alias("__b"))
    la, lb = F.size("__a"), F.size("__b")
    least = F.ceil((la + lb) * (similar / 2) - 1e-9)
    singly = F.col("key").startswith("1")
    # a pair is compared for the kind of key that is sure to find it
    fit = (F.least(la, lb) >= least) & F.when((F.greatest(la, lb) > TWO) | (least < 2), singly | (la + lb == 0)).otherwise(~singly)
    met = one.join(two, [*by, "key"]).where(fit).where(F.size(F.array_intersect("__a", "__b")) >= least)
    different = met.select(*by, "a", "b").distinct()
    return different.withColumn("ratio", subsequence_ratio("a", "b")).where(F.col("ratio") >= similar)
