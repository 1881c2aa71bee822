"""Joins between experiments, grouped statistics and table-shaped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import sem


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the results don't have yet: skipping what exists, resuming, caching."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def outer_compared(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``key, left, right, side``: in both, only left or only right."""
    a, b = left.select(key, F.col(value).alias("left"), F.lit(True).alias("__a")), right.select(key, F.col(value).alias("right"), F.lit(True).alias("__b"))
    side = F.when(F.col("__b").isNull(), "left_only").when(F.col("__a").isNull(), "right_only").otherwise("both")
    return a.join(b, key, "full").select(key, "left", "right", side.alias("side"))


def by_position(rows: DataFrame, position: str, value: str, *keys: str) -> DataFrame:
    """Mean and standard error (population) at each position."""
    return rows.groupBy(*keys, position).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sem(value).alias("sem"))


def differences(rows: DataFrame, item: str, position: str, value: str, *, most: int | None = None) -> DataFrame:
    """``item, diff_position, diff`` between consecutive positions, from 1."""
    w = Window.partitionBy(item).orderBy(position)
    out = rows.select(item, F.row_number().over(w).alias("__n"), (F.col(value) - F.lag(value).over(w)).alias("diff")).where("diff is not null")
    out = out.select(item, (F.col("__n") - 1).alias("diff_position"), "diff")
    return out if most is None else out.where(F.col("diff_position") <= most)


def first_and_last(rows: DataFrame, item: str, position: str, value: str, *, at_least: int = 2) -> DataFrame:
    return rows.groupBy(item).agg(F.count("*").alias("points"), F.min_by(value, position).alias("first"), F.max_by(value, position).alias("last")).where(F.col("points") >= at_least)


def last_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in an explicit order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def top(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k of each key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def first(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in an explicit order: a run that stops after so many items."""
    return rows.orderBy(*order).limit(n)


def bands(rows: DataFrame, order: list[Column], size: int, *keys: str) -> DataFrame:
    """Adds ``band``: 0 for the first ``size`` rows of each key in the given order, 1 for the next, and so on."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("band", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The n rows of the smallest seeded hashes: the same each time."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def frequencies(rows: DataFrame, value: str, *, most: int | None = None) -> DataFrame:
    counted = rows.groupBy(value).agg(F.count("*").alias("n"))
    ordered = counted.orderBy(F.col("n").desc(), value)
    return ordered if most is None else ordered.limit(most)


def repeated(rows: DataFrame, value: str, member: str) -> DataFrame:
    """Values that occur more than once: how often, in how many members, and the first and last of these."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.countDistinct(member).alias("members"), F.min(member).alias("first_member"), F.max(member).alias("last_member")).where("n > 1")


def name_spread(rows: DataFrame, group: str, item: str, name: str) -> DataFrame:
    """``name, groups, items``: in how many groups and items a name is, most spread first."""
    return rows.groupBy(name).agg(F.countDistinct(group).alias("groups"), F.countDistinct(item).alias("items")).orderBy(F.col("groups").desc(), F.col("items").desc(), name)


def run_counts(rows: DataFrame, run: str, item: str) -> DataFrame:
    return rows.groupBy(run).agg(F.countDistinct(item).alias("items"), F.count("*").alias("rows"), (F.count("*") / F.countDistinct(item)).alias("rows_per_item"))


def statuses(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("successful", "failed", "skipped")])


def table(rows: DataFrame, row: str, column_name: str, columns: list[str], **measures: Column) -> DataFrame:
    """A report: a line for each value of ``row``, and for each of the given columns its measures."""
    return rows.groupBy(row).pivot(column_name, columns).agg(*[m.alias(name) for name, m in measures.items()])


def set_agreement(left: str | Column, right: str | Column) -> Column:
    """Whether two arrays hold the same values."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (left, right))
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def line_numbers(rows: DataFrame, item: str, text: str, *, delimiter: str = "\n") -> DataFrame:
    """``item, lines, numbered, first_number, gaps, misplaced``: what is odd about the bracketed numbers that lines start with."""
    lines = rows.select(item, F.posexplode(F.split(text, delimiter, -1)).alias("at", "line"))
    lines = lines.withColumn("n", F.nullif(F.regexp_extract("line", r"^\[(\d+)\]", 1), F.lit("")).try_cast("long"))
    w = Window.partitionBy(item).orderBy("at")
    before = F.last("n", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = lines.withColumn("__before", before)
    return marked.groupBy(item).agg(
        F.count("*").alias("lines"),
        F.count("n").alias("numbered"),
        F.min_by("n", F.when(F.col("n").isNotNull(), F.col("at"))).alias("first_number"),
        F.count_if(F.col("n") != F.col("__before") + 1).alias("gaps"),
        F.count_if(F.col("n") != F.col("at") + 1).alias("misplaced"),
    )


def split_distribution(rows: DataFrame, split: str, key: str) -> DataFrame:
    return rows.groupBy(split).agg(F.count("*").alias("n"), (F.count("*") == F.countDistinct(key)).alias("unique_keys"))


def corpus_summary(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """Lengths of texts: least, largest, floored mean, total, and how many are empty, short and very long."""
    n = F.length(text)
    return rows.groupBy(*keys).agg(F.count("*").alias("texts"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.floor(F.sum(n) / F.count(n)).cast("long").alias("avg_chars"), F.sum(n).alias("total_chars"), F.count_if(n == 0).alias("empty"), F.count_if(n < 1000).alias("under_1k"), F.count_if(n > 1_000_000).alias("over_1m"))


def item_word_counts(rows: DataFrame, item: str, chunks: str, *, drop_last: str = "never") -> DataFrame:
    """``item, chunks, words``; ``drop_last`` is never, always (if there are several) or the name of a flag column."""
    from ..functions.text import word_count

    c = F.col(chunks)
    several = F.size(c) > 1
    drop = F.lit(False) if drop_last == "never" else several if drop_last == "always" else several & F.col(drop_last)
    some = F.when(drop, F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(1)))).otherwise(c)
    return rows.select(item, F.size(some).cast("long").alias("chunks"), F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + word_count(x)).alias("words"))
