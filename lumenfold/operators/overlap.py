"""Overlap of texts: n-gram overlap, longest common subsequences, continuity of consecutive steps.

Both texts of a pair stand in one row, so nothing is shuffled: clipped n-gram counts and longest common subsequences run in
Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORES = T.StructType([T.StructField(x, T.DoubleType()) for x in ("precision", "recall", "f1")])


def tokens(text: str | Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), "[^a-z0-9]+", -1), lambda w: w != "")


def ngrams(tokens_col: Column, n: int) -> Column:
    """The n-grams, their words joined by blanks."""
    if n == 1:
        return tokens_col

    def of(t: Column) -> Column:
        m = F.size(t) - n + 1
        return F.when(m > 0, F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    # bound once: inside the inner lambda the tokens would be made anew for each n-gram
    return F.get(F.transform(F.array(tokens_col), of), F.lit(0))


def score(overlap: Column, target: Column, prediction: Column) -> Column:
    """Precision, recall and F1 as shares; empty sides give zeros."""
    p = F.when(prediction > 0, overlap / prediction).otherwise(F.lit(0.0))
    r = F.when(target > 0, overlap / target).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), f.alias("f1"))


COUNTS = T.StructType([T.StructField(x, T.LongType()) for x in ("overlap", "n_target", "n_prediction")])


def _counted(n: int, stem: bool):
    """Clipped n-gram counts of two texts; texts that come again in a batch are counted once."""

    @F.pandas_udf(COUNTS)
    def run(target: pd.Series, prediction: pd.Series) -> pd.DataFrame:
        grams, stems = {}, {}

        def of(text: str | None) -> Counter:
            if text not in grams:
                w = plain_tokens(text or "")
                if stem:
                    w = [stems.setdefault(x, porter_stem(x)) if x not in stems else stems[x] for x in w]
                grams[text] = Counter(w if n == 1 else zip(*(w[k:] for k in range(n)), strict=False))
            return grams[text]

        rows = []
        for t, p in zip(target, prediction, strict=True):
            a, b = of(t), of(p)
            small, large = (a, b) if len(a) < len(b) else (b, a)
            rows.append((sum(min(k, large[g]) for g, k in small.items() if g in large), a.total(), b.total()))
        return pd.DataFrame(rows, columns=COUNTS.names, dtype="int64")

    return run


def rouge_n(pairs: DataFrame, n: int, *, keys: list[str], target: str = "target", prediction: str = "prediction", stem: bool = False) -> DataFrame:
    """``keys, overlap, n_target, n_prediction, score`` of each pair (row): clipped n-gram counts, of stems with ``stem``.

    Both texts stand in the row, so nothing is shuffled; null and empty texts have no n-grams.
    """
    counted = pairs.select(*keys, _counted(n, stem)(target, prediction).alias("__c")).select(*keys, "__c.*")
    return counted.withColumn("score", score(F.col("overlap"), F.col("n_target"), F.col("n_prediction")))


def rouge_scores(pairs: DataFrame, *, keys: list[str], target: str = "target", prediction: str = "prediction", stem: bool = True) -> DataFrame:
    """``keys`` and a line for each metric and measure as the stemming tool prints them: ``rouge-1`` to ``rouge-4`` and ``rouge-l``, in percent to three places."""
    parts = [_counted(n, stem)(target, prediction).alias(f"n{n}") for n in range(1, 5)]
    sides = [stemmed(tokens(c)) if stem else tokens(c) for c in (target, prediction)]
    made = pairs.select(*keys, *parts, rouge_l(*sides).alias("l"))
    found = [(f"rouge-{n}", score(F.col(f"n{n}.overlap"), F.col(f"n{n}.n_target"), F.col(f"n{n}.n_prediction"))) for n in range(1, 5)] + [("rouge-l", F.col("l"))]
    lines = F.array(*[F.struct(F.lit(name).alias("metric"), *[(F.floor(s[m] * 1e5 + 0.5) / 1e3).alias(m) for m in SCORES.names]) for name, s in found])
    return made.select(*keys, F.explode(lines).alias("x")).select(*keys, "x.*")


def _rows(masks: dict, words: Sequence, row: int, full: int) -> Iterator[int]:
    """Rows of the table of common subsequences, a bit for each word of the other side: 0 where the length grows."""
    for w in words:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _masks(words: Sequence) -> dict:
    """The places of each word, as bits."""
    masks: dict = {}
    for k, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << k
    return masks


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Longest common subsequence, a whole row of the table at a time as the bits of one number."""
    full = (1 << len(b)) - 1
    row = full
    for row in _rows(_masks(b), a, full, full):  # noqa: B007
        pass
    return len(b) - row.bit_count()


def lcs_members(a: Sequence, b: Sequence) -> set[int]:
    """Positions in ``a`` of one longest common subsequence.

    Of the table's rows about the square root of their number is held: every so many, and those of the stretch that is walked back through.
    """
    n, full, masks = len(a), (1 << len(b)) - 1, _masks(b)
    step = max(1, math.isqrt(n))
    marks = [full]  # rows 0, step, 2 * step ...
    for k, row in enumerate(_rows(masks, a, full, full), 1):
        if k % step == 0:
            marks.append(row)
    out, i, j, start, rows = set(), n, len(b), n + 1, []
    while i and j:
        if i - 1 < start:
            start = (i - 1) // step * step
            rows = [marks[start // step], *_rows(masks, a[start:i], marks[start // step], full)]
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
            continue
        low = (1 << j) - 1
        above = j - (rows[i - 1 - start] & low).bit_count()
        left = j - 1 - (rows[i - start] & (low >> 1)).bit_count()
        if above > left:
            i -= 1
        else:
            j -= 1
    return out


def _shares(overlap: float, target: int, prediction: int) -> tuple[float, float, float]:
    p, r = overlap / prediction if prediction else 0.0, overlap / target if target else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


@F.pandas_udf(SCORES)
def rouge_l(target: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    """Of two token arrays."""
    rows = [_shares(lcs_length([*t], [*p]), len(t), len(p)) if t is not None and p is not None else (0.0, 0.0, 0.0) for t, p in zip(target, prediction, strict=True)]
    return pd.DataFrame(rows, columns=SCORES.names)


def plain_tokens(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def plain_sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if s]


def _lsum(target: str, prediction: str) -> tuple[float, float, float]:
    left, right = ([plain_tokens(s) for s in plain_sentences(x or "")] for x in (target, prediction))
    t_left, p_left = Counter(w for s in left for w in s), Counter(w for s in right for w in s)
    hits = 0
    for sentence in left:
        union: set[int] = set()
        for other in right:
            union |= lcs_members(sentence, other)
        for k in sorted(union):
            w = sentence[k]
            if t_left[w] > 0 and p_left[w] > 0:
                hits += 1
                t_left[w] -= 1
                p_left[w] -= 1
    return _shares(hits, sum(map(len, left)), sum(map(len, right)))


@F.pandas_udf(SCORES)
def rouge_lsum(target: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    """Of two texts: each target sentence's union of common subsequences with all sentences of the other, words clipped."""
    return pd.DataFrame([_lsum(t, p) for t, p in zip(target, prediction, strict=True)], columns=SCORES.names)


def adjacent(steps: DataFrame, item: str, step: str, text: str) -> DataFrame:
    """``item, step, target, prediction``: each step's text with the one before it."""
    w = Window.partitionBy(item).orderBy(step)
    return steps.select(item, step, F.lag(text).over(w).alias("target"), F.col(text).alias("prediction")).where("target is not null")


def continuity(steps: DataFrame, item: str, step: str, text: str, *, n: int | str = 2) -> DataFrame:
    """``item, pairs, precision, recall, f1``: mean overlap of consecutive steps (items with one step have none).

    ``n`` is the length of n-grams, or ``l`` or ``lsum`` for longest common subsequences of texts or sentences.
    """
    pairs = adjacent(steps, item, step, text)
    if n == "l":
        scored = pairs.select(item, rouge_l(tokens("target"), tokens("prediction")).alias("score"))
    elif n == "lsum":
        scored = pairs.select(item, rouge_lsum("target", "prediction").alias("score"))
    else:
        scored = rouge_n(pairs, n, keys=[item, step])
    return scored.groupBy(item).agg(F.count("*").alias("pairs"), *[F.avg(f"score.{m}").alias(m) for m in SCORES.names])


def primary_value(metrics: str = "metrics") -> Column:
    """The F1 that stands for a map of metrics: of ``rouge-1`` if there is one, else the first found."""
    m = F.col(metrics)
    return F.coalesce(F.try_element_at(m, F.lit("rouge-1"))["f1"], F.get(F.map_values(m), F.lit(0))["f1"])


def porter_stem(word: str) -> str:
    """The published suffix-stripping algorithm of 1980; words of three letters and fewer stay."""
    from .stemmer import stem

    return stem(word) if len(word) > 3 else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(tokens_col: pd.Series) -> pd.Series:
    memo: dict[str, str] = {}

    def one(words) -> list[str] | None:
        if words is None:
            return None
        return [memo.setdefault(w, porter_stem(w)) if w not in memo else memo[w] for w in words]

    return tokens_col.map(one)
