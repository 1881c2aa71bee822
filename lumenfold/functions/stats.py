"""Statistics with the definitions that reports rely on: which median, which deviation, which edge of a bucket."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dollars for a million tokens in and out.
PRICES = {
    "gpt-4.1-mini": (0.40, 1.60),
    "gpt-4o": (2.50, 10.00),
    "o1-mini": (1.10, 4.40),
    "o3": (2.00, 8.00),
    "gpt-5": (1.25, 10.00),
    "gpt-4.1": (2.00, 8.00),
    "gpt-5-mini": (0.25, 2.00),
    "gpt-4o-search-preview": (2.50, 10.00),
}


def column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fixed(x: str | Column, digits: int) -> Column:
    """Rounded half up on the binary value: the same in every engine."""
    return F.floor(column(x) * 10**digits + 0.5) / 10**digits


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, upper_median``: the element at n // 2 of the sorted values.

    That is the discrete median from above; the aggregate keeps counts of values and combines them before the shuffle, so no group's rows are gathered.
    """
    name = value.replace("`", "``")
    grouped = df.where(F.col(value).isNotNull()).groupBy(*keys)
    return grouped.agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)").cast(df.schema[value].dataType).alias("upper_median"))


def sem(value: str | Column, *, ddof: int = 0) -> Column:
    """Standard error of the mean, with the population's (0) or the sample's (1) deviation; 0 of one sample value."""
    v = column(value)
    deviation = F.stddev_pop(v) if ddof == 0 else F.coalesce(F.stddev_samp(v), F.lit(0.0))
    return deviation / F.sqrt(F.count(v))


def binomial_se(p: str | Column, n: str | Column) -> Column:
    p, n = column(p), column(n)
    return F.when(n > 1, F.sqrt(p * (1 - p) / n)).otherwise(F.lit(0.0))


def percent(x: str | Column) -> Column:
    """0.44 of ``44%``, ``44`` or 44; null of anything else."""
    return F.rtrim(F.trim(column(x).cast("string")), F.lit("%")).try_cast("double") / 100


def length_bucket(x: str | Column, edges: tuple[int, ...] = (2500, 5000, 10000)) -> Column:
    """Right-closed buckets; 0 and less, and null, are in none."""
    x = column(x)
    out, low = F.when(x <= 0, None), 0
    for high in edges:
        out = out.when(x <= high, f"{low}-{high}")
        low = high
    return out.when(x > low, f"{low}+")


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    return F.sum(column(value) * column(weight)) / F.sum(column(weight))


def random_guess(suspects: str | Column) -> Column:
    """Mean of one over the number of suspects, which are parted by commas; rows without any count for nothing."""
    n = F.size(F.filter(F.transform(F.split(column(suspects), ","), F.trim), lambda x: x != ""))
    return F.avg(F.when(n > 0, 1 / n))


def human_estimate(share: str | Column, attempts: str | Column) -> tuple[Column, Column]:
    """Mean of solving shares and its standard error from the attempts behind each."""
    p, m = column(share), column(attempts)
    return F.avg(p), F.sqrt(F.sum(p * (1 - p) / m)) / F.count(p)


def metric_statistics(value: str | Column) -> list[Column]:
    v = column(value)
    return [F.count("*").alias("n"), F.count(v).alias("successes"), (F.count("*") - F.count(v)).alias("failures"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")]


def distribution(value: str | Column) -> list[Column]:
    v = column(value)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), q[1].alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), q[0].alias("q1"), q[2].alias("q3")]


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """``bin, n`` of equal-width bins between the least and the largest value, which belongs to the last bin."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(F.lit(0))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def token_estimate(text: str | Column) -> Column:
    """1.3 tokens a word, cut to a whole number."""
    from .text import word_count

    return F.floor(word_count(text) * 1.3).cast("long")


def _price(model: Column, which: int) -> Column:
    table = F.create_map(*[F.lit(y) for name, prices in PRICES.items() for y in (name, prices[which])])
    return F.try_element_at(table, model)


def token_cost(model: str | Column, tokens_in: str | Column, tokens_out: str | Column) -> Column:
    """Dollars, to six places; a model without a price is an error."""
    m = column(model)
    cost = column(tokens_in) / 1e6 * _price(m, 0) + column(tokens_out) / 1e6 * _price(m, 1)
    return F.when(cost.isNull() & m.isNotNull(), F.raise_error(F.concat(F.lit("no price for model "), m)).cast("double")).otherwise(fixed(cost, 6))


def takes_temperature(model: str | Column) -> Column:
    m = column(model)
    return ~m.rlike("^(o1|o3|o4|gpt-5)") & ~F.contains(m, F.lit("search-preview"))


def known_provider(model: str | Column) -> Column:
    return column(model).rlike("^(gpt|o1|o3|o4)")


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2x2 table: all tables of the same margins that are no likelier."""
    n, r, k = a + b + c + d, a + b, a + c

    def log_p(x: int) -> float:
        pick = lambda m, j: math.lgamma(m + 1) - math.lgamma(j + 1) - math.lgamma(m - j + 1)
        return pick(r, x) + pick(n - r, k - x) - pick(n, k)

    own = log_p(a)
    return min(1.0, sum(math.exp(p) for x in range(max(0, k - (n - r)), min(r, k) + 1) if (p := log_p(x)) <= own + 1e-7))


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_exact(*map(int, x)) for x in zip(a, b, c, d, strict=True)])


def median_split(df: DataFrame, value: str, success: str) -> DataFrame:
    """Counts of successes and failures above and up to the median: ``above_yes, above_no, below_yes, below_no``."""
    middle = df.agg(F.percentile(value, F.lit(0.5)).alias("__m"))
    rows = df.crossJoin(F.broadcast(middle))
    above, yes = F.col(value) > F.col("__m"), F.col(success)
    return rows.agg(F.count_if(above & yes).alias("above_yes"), F.count_if(above & ~yes).alias("above_no"), F.count_if(~above & yes).alias("below_yes"), F.count_if(~above & ~yes).alias("below_no"))
