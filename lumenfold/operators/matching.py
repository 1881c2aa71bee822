"""Numbers of alike names by longest matching blocks, without a row for each pair.

A scope's different names are dealt by a hash into parts of up to about ``PART`` names, and each pair of parts is a cell, which is one group of a grouped map: cells are independent, of about one
size and spread over all tasks, and a cell gives one row for each of its names.  Within a cell arrays decide pairs in this order, each step exact:

* names with one ending that is long enough are alike, however they begin;
* if one character is missing beside an ending longer than both stems, they are alike if the stems (letters and digits) have a character in common: nothing off the ending's own diagonal
  can be as long as the ending, as its first character is in no stem;
* names that have too many characters without a counterpart aren't alike, as matching blocks are a common subsequence;
* the blocks of what is left are found for thousands of pairs at once, longest first, the first of equally long ones, as ``difflib`` does.
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import folder, saved
from .overlap import lcs_length

#: Different names of a part at most, about; a cell compares two parts.  Scopes of fewer than ``FEW`` such parts have up to ``FEW`` smaller ones, of an eighth at least.
PART, FEW = 4096, 16
#: Longer names are compared one pair at a time; ``difflib`` leaves frequent characters out of those of 200 or more.
SHORT = 64
#: Pairs that are decided at once: those of rows and columns, and those whose blocks are found.
AT_ONCE, BLOCKS_OF = 1 << 20, 1 << 14


def least_common(most: int, similar: float) -> np.ndarray:
    """For each sum of two lengths up to ``most``: the least number of matching characters with a ratio of ``similar``."""
    total = np.arange(most + 1)
    least = np.ceil(total * similar / 2).astype(np.int64)
    some = np.maximum(total, 1)
    least -= 2.0 * (least - 1) / some >= similar
    least += 2.0 * least / some < similar
    return least


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each column of two tables of codes: length and ends of the longest common block, the first of equally long ones."""
    wide = max(len(a), len(b)) > 32
    kind, bits = (np.uint32, 6) if wide else (np.uint16, 5)
    step, last = kind(1 << 2 * bits), (1 << bits) - 1
    ends = np.arange(last, last - len(b), -1).astype(kind)[:, None]
    best, runs = np.zeros(a.shape[1], kind), np.zeros((len(b) + 1, a.shape[1]), kind)
    for i, chars in enumerate(a):
        runs[1:] = (runs[:-1] + step) * (b == chars)
        np.maximum(best, (runs[1:] + (ends + kind(last - i << bits))).max(axis=0), out=best)
    length = (best >> kind(2 * bits)).astype(np.int64)
    return length, last - (best >> kind(bits) & kind(last)).astype(np.int64) + 1, last - (best & kind(last)).astype(np.int64) + 1


def _part(codes: np.ndarray, pair: np.ndarray, start: np.ndarray, end: np.ndarray, pad: int) -> np.ndarray:
    at = start + np.arange((end - start).max())[:, None]
    return np.where(at < end, codes[np.minimum(at, len(codes) - 1), pair], codes.dtype.type(pad))


def blocks_suffice(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, least: np.ndarray, pads: tuple[int, int]) -> np.ndarray:
    """For each column of two tables of codes, filled up with ``pads``: do the matching blocks have ``least`` characters?"""
    pair, got = np.arange(a.shape[1]), np.zeros(a.shape[1], np.int64)
    regions = (pair, np.zeros_like(la), la, np.zeros_like(lb), lb)
    some = (a, b)
    while len(regions[0]):
        pair, a0, a1, b0, b1 = regions
        length, ae, be = _longest(*some)
        np.add.at(got, pair, length)
        ae, be = a0 + ae, b0 + be
        left, right = (pair, a0, ae - length, b0, be - length), (pair, ae, a1, be, b1)
        regions = tuple(np.concatenate(x) for x in zip(left, right, strict=True))
        there = np.tile(length > 0, 2)
        size = np.where(there, np.minimum(regions[2] - regions[1], regions[4] - regions[3]), 0)
        more = np.bincount(regions[0], size, len(got)).astype(np.int64)
        go_on = (size > 0) & ((got < least) & (got + more >= least))[regions[0]]
        regions = tuple(x[go_on] for x in regions)
        if go_on.any():
            some = _part(a, regions[0], regions[1], regions[2], pads[0]), _part(b, regions[0], regions[3], regions[4], pads[1])
    return got >= least


class _Names:
    """The names of a cell as arrays, by length and ending."""

    def __init__(self, names: list[str]):
        of = np.array([len(x) for x in names])
        flat, codes = np.unique(np.frombuffer("".join(names).encode("utf-32-le"), np.uint32), return_inverse=True)
        owner, start = np.repeat(np.arange(len(names)), of), np.cumsum(of) - of
        place = np.arange(len(codes)) - start[owner]
        bit = np.array([int(chr(c), 36) + 26 * (65 <= c <= 90) if c < 128 and chr(c).isalnum() else -1 for c in flat.tolist()] or [-1])
        stem = of.copy()
        np.minimum.at(stem, owner, np.where(bit[codes] < 0, place, len(codes)))
        inside = place < stem[owner]
        self.stems = np.zeros(len(names), np.uint64)
        np.bitwise_or.at(self.stems, owner[inside], np.uint64(1) << bit[codes[inside]].astype(np.uint64))
        # characters numbered by occurrence; the commonest 64 of them have a bit of their own
        key = owner * len(flat) + codes
        order = np.argsort(key, kind="stable")
        again = np.arange(len(key)) - np.searchsorted(key[order], key[order])
        kinds, which, often = np.unique(again * len(flat) + codes[order], return_inverse=True, return_counts=True)
        rank = np.empty(len(kinds), np.uint64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(kinds))
        self.chars = np.zeros(len(names), np.uint64)
        np.bitwise_or.at(self.chars, owner[order], np.uint64(1) << rank[which] % np.uint64(64))
        known: dict[str, int] = {}
        self.ending = np.array([known.setdefault(x[k:], len(known)) for x, k in zip(names, stem.tolist(), strict=True)])
        self.names, self.length, self.stem = names, of, stem
        self.pads = len(flat), len(flat) + 1
        self.codes = np.full((len(names), min(of.max(), SHORT)), self.pads[0], np.uint8 if len(flat) < 250 else np.uint32)
        short = of[owner] <= SHORT
        self.codes[owner[short], place[short]] = codes[short]

    def alike(self, one: np.ndarray, two: np.ndarray, least: np.ndarray, similar: float) -> np.ndarray:
        """Are the names at ``one`` like those at ``two``, which come later?"""
        out = np.zeros(len(one), bool)
        short = np.maximum(self.length[one], self.length[two]) <= SHORT
        at = np.flatnonzero(short)
        for some in (at[i : i + BLOCKS_OF] for i in range(0, len(at), BLOCKS_OF)):
            i, j, la, lb = one[some], two[some], self.length[one[some]], self.length[two[some]]
            a, b = np.ascontiguousarray(self.codes[i, : la.max()].T), np.ascontiguousarray(self.codes[j, : lb.max()].T)
            b[b == self.pads[0]] = self.pads[1]
            out[some] = blocks_suffice(a, la, b, lb, least[some], self.pads)
        for k in np.flatnonzero(~short).tolist():
            a, b = self.names[one[k]], self.names[two[k]]
            out[k] = lcs_length(a, b) >= least[k] and difflib.SequenceMatcher(None, a, b).ratio() >= similar
        return out


def _cell(similar: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        first, last, n = (table[x].to_numpy() for x in ("first", "last", "n"))
        names = _Names(table["x"].to_pylist())
        left = table["part"].to_numpy() == table["lo"][0].as_py()
        own = left.all()
        by_shape = np.lexsort((names.ending, names.length))
        rows, cols = by_shape[left[by_shape]], by_shape[left[by_shape] if own else ~left[by_shape]]
        links, one_way = np.zeros(len(n), np.int64), []
        least = least_common(2 * int(names.length.max()), similar)
        length, ending, stem, chars = names.length, names.ending, names.stem, names.chars
        shapes = np.flatnonzero(np.diff(length[rows], prepend=-1) | np.diff(ending[rows], prepend=-1))
        for begin, end in zip(shapes, [*shapes[1:], len(rows)], strict=True):
            r0 = rows[begin]
            of = least[length[r0] + length[cols]]
            near = cols[np.minimum(length[r0], length[cols]) >= of]
            of = least[length[r0] + length[near]]
            ends = np.where((ending[near] == ending[r0]) & (length[near] <= SHORT) & (length[r0] <= SHORT), length[near] - stem[near], 0)
            sure = ends >= of
            by_stem = (of - ends == 1) & (ends > stem[near]) & (ends > stem[r0])
            open_ = ~sure & ~by_stem
            wide = max(AT_ONCE // max(len(near), 1), 1)
            for r in (rows[i : min(i + wide, end)] for i in range(begin, end, wide)):
                if sure.any():
                    links[r] += n[near[sure]].sum()
                    if not own:
                        links[near[sure]] += n[r].sum()
                    elif (sure & (near == r[0])).any():  # a name isn't its own partner, and its shape has it in here
                        links[r] -= n[r]
                if by_stem.any():
                    c = near[by_stem]
                    met = (names.stems[r][:, None] & names.stems[c]) != 0
                    if own:
                        met &= r[:, None] != c
                    links[r] += met @ n[c]
                    if not own:
                        links[c] += n[r] @ met
                if open_.any():
                    c = near[open_]
                    lone = np.bitwise_count(chars[r][:, None] & ~chars[c])
                    i, j = np.nonzero(lone <= (length[r0] - of[open_]))
                    need, i, j = of[open_][j], r[i], c[j]
                    if own:
                        need, i, j = need[i != j], i[i != j], j[i != j]
                    ahead, behind = first[i] < last[j], first[j] < last[i]
                    f, g = np.zeros(len(i), bool), np.zeros(len(i), bool)
                    f[ahead] = names.alike(i[ahead], j[ahead], need[ahead], similar)
                    g[behind] = names.alike(j[behind], i[behind], need[behind], similar)
                    split = ahead & behind & (f != g)
                    whole = (f | g) & ~split
                    np.add.at(links, i[whole], n[j[whole]])
                    if not own:
                        np.add.at(links, j[whole], n[i[whole]])
                    split &= (i < j) | (not own)
                    swap = n[i[split]] < n[j[split]]
                    one_way.append((np.where(swap, j[split], i[split]), np.where(swap, i[split], j[split]), np.where(f[split] ^ swap, 1, -1)))
        linked = np.flatnonzero(links)
        common, rare, sign = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*one_way, strict=True)) if one_way else [np.zeros(0, np.int64)] * 3
        at, number = np.concatenate([linked, common]), np.concatenate([links[linked], sign])
        partner = [None] * len(linked) + [names.names[y] for y in rare.tolist()]
        keys = [x for x in table.column_names if x not in ("lo", "hi", "part", "x", "n", "first", "last")]
        return pa.table({**{x: table[x].take(at) for x in keys}, "x": table["x"].take(at), "y": pa.array(partner, pa.string()), "links": number})

    return run


def links(names: DataFrame, block: list[str], name: str, order: str, similar: float = 0.7) -> DataFrame:
    """``block, order, class_id, links``: each row with the first row of its name in its block, and the number of the block's other rows that it is alike.

    Of two rows the first in ``order`` comes first, as the ratio depends on it; rows of one name are alike.  ``order`` is a number, different for all rows of a block.  Rows without a name or
    block have no class and no links.  ``similar`` is over 0 and at most 1.
    """
    spark = names.sparkSession
    path = folder(spark, "links")
    rows = names.select(*block, F.col(name).alias("x"), F.col(order).alias("k"))
    whole = F.col("x").isNotNull()
    for b in block:
        whole &= F.col(b).isNotNull()
    classes = saved(rows.where(whole).groupBy(*block, "x").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("k").alias("last")), f"{path}/classes")
    in_parts = lambda size: F.ceil(F.count("*") / size).cast("int")
    parts = classes.groupBy(*block).agg(F.greatest(in_parts(PART), F.least(in_parts(PART / 8), F.lit(FEW))).alias("parts"))
    # little data and much work: as many tasks as there are, whatever their sizes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    placed = classes.repartition(tasks, *block, "x").join(parts, block).withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("lo"), F.greatest("part", q).alias("hi"))))
    cells = placed.select(*block, "part", "x", "n", "first", "last", cell.alias("cell")).select(*block, "cell.lo", "cell.hi", "part", "x", "n", "first", "last")
    fields = [classes.schema[x] for x in [*block, "x"]]
    schema = T.StructType([*fields, T.StructField("y", T.StringType()), T.StructField("links", T.LongType())])
    dealt = cells.repartition(tasks, *block, "lo", "hi")
    found = saved(dealt.groupBy(*block, "lo", "hi").applyInArrow(_cell(similar), schema), f"{path}/found")
    total = found.where("y is null").groupBy(*block, "x").agg(F.sum("links").alias("others"))
    of_name = classes.join(total, [*block, "x"], "left").select(*block, "x", "first", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("others"))
    known = rows.join(of_name, [*block, "x"], "left")
    return known.join(_one_way(rows, found, block), [*block, "k"], "left").select(
        *block, F.col("k").alias(order), F.col("first").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("links")
    )


def _one_way(rows: DataFrame, found: DataFrame, block: list[str]) -> DataFrame:
    """``block, k, more``: links of names that are alike in one order only and have rows in both.

    Of two such names ``x`` has more rows; ``links`` is 1 if it comes first, -1 if second.  The rows of ``x`` are put in order with those of all its partners, once for all of them.
    """
    pairs = found.where("y is not null").select(*block, "x", "y", F.col("links").alias("sign"))
    points = pairs.join(rows.withColumnRenamed("x", "y"), [*block, "y"]).select(*block, "x", "k", "sign")
    own = pairs.select(*block, "x").distinct().join(rows, [*block, "x"]).select(*block, "x", "k", F.lit(0).cast("long").alias("sign"))
    near = Window.partitionBy(*block, "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before, after = near.orderBy("k"), near.orderBy(F.col("k").desc())
    number = lambda sign, w: F.sum((F.col("sign") == sign).cast("long")).over(w)
    more = F.when(F.col("sign") == 1, number(0, before)).when(F.col("sign") == -1, number(0, after)).otherwise(number(1, after) + number(-1, before))
    return points.unionByName(own).select(*block, "k", more.alias("more")).groupBy(*block, "k").agg(F.sum("more").alias("more"))
