"""Retrieval of passages by BM25: an index of tables, and exact top-k searches that finish few pairs.

An index holds, by term, the passages with what the term adds to their score (its impact); for each term its largest impact, and the largest in
each block of passages; and for each passage the impacts of all its terms.  A search

1. scores the passages of each query's rarest terms, which gives a score that the k-th best has at least;
2. starts only pairs with a term that matters: a query's terms by largest impact, until what the others can add together is a set share of that score;
3. leaves out pairs that can't reach the score with the largest impacts that the other terms have in the passage's block;
4. finishes the rest from the passages' own rows.

Nothing that could be among the best is left out, so the result is that of scoring all pairs.  Everything is joins and grouping on column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import column
from ..sources.scratch import folder, saved
from .overlap import tokens

#: Passages of a block on average, postings of a query's rarest terms that are scored first, and the share of the score that other terms may reach.
BLOCK, SEEDS, SHARE = 64, 400, 0.6
#: Scores are whole millionths, so that ties are ties.
UNIT = 1e6
#: A term in more than this share of the passages (one in so many) meets its postings where they are, its statistics being broadcast.
FREQUENT = 100


@dataclass(frozen=True)
class Index:
    """Tables of an index; ``scope`` are the columns within which passages compete and are counted."""

    postings: DataFrame
    passages: DataFrame
    terms: DataFrame
    tops: DataFrame
    scope: tuple[str, ...]

    @classmethod
    def read(cls, spark, path: str, scope: tuple[str, ...] = ()) -> Index:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "passages", "terms", "tops")], tuple(scope))


def build(passages: DataFrame, path: str, *, passage_id: str, text: str, scope: tuple[str, ...] = (), k1: float = 1.5, b: float = 0.75, block: int = BLOCK) -> Index:
    """Writes an index of ``passages`` to ``path``.

    Numbers of passages, mean lengths (of those with words) and document frequencies are of all passages of a scope.  Rows of one id (and scope) are one passage; rows without
    an id or without words aren't found, but those with an id count as passages.
    """
    spark, scope = passages.sparkSession, list(scope)
    own = passages.where(F.col(passage_id).isNotNull()).select(*scope, F.col(passage_id).alias("passage"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    counts = saved(own.select(*scope, "passage", F.explode("w").alias("term")).groupBy(*scope, "passage", "term").agg(F.count("*").alias("tf")), f"{path}/counts")
    lengths = own.groupBy(*scope, "passage").agg(F.sum(F.size("w")).alias("dl"))
    stats = lengths.groupBy(*scope).agg(F.count("*").alias("n"), F.avg(F.nullif(F.col("dl"), F.lit(0))).alias("avgdl"))
    # a row for each scope; without scopes there is one
    totals = lengths.join(stats, scope) if scope else lengths.crossJoin(F.broadcast(stats))
    df = counts.groupBy(*scope, "term").agg(F.count("*").alias("df"))
    n = None if scope else (stats.first()["n"] or 0)
    sized = counts.join(totals, [*scope, "passage"])
    if n is None:
        joined = sized.join(df, [*scope, "term"])
    else:  # a passage has so many terms, so few of them are frequent
        frequent = F.col("df") > n / FREQUENT
        joined = sized.join(F.broadcast(df.where(frequent)), "term").unionByName(sized.join(F.broadcast(df.where(frequent).select("term")), "term", "left_anti").join(df.where(~frequent), "term"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.lit(1))
    made = joined.select(*scope, "term", "passage", F.pmod(F.xxhash64("passage"), blocks).alias("block"), impact.alias("impact"))
    # by term and passage, so a frequent term has several files
    postings = saved(made.repartitionByRange(*scope, "term", "passage").sortWithinPartitions(*scope, "term", "passage"), f"{path}/postings")
    rows = saved(postings.groupBy(*scope, "passage").agg(F.map_from_entries(F.collect_list(F.struct("term", "impact"))).alias("impacts")), f"{path}/passages")
    terms = saved(postings.groupBy(*scope, "term").agg(F.count("*").alias("df"), F.max("impact").alias("top")), f"{path}/terms")
    tops = saved(postings.groupBy(*scope, "term", "block").agg(F.max("impact").alias("top")), f"{path}/tops")
    return Index(postings, rows, terms, tops, tuple(scope))


def _rounded(score: Column) -> Column:
    return F.floor(score * UNIT + 0.5) / UNIT


def stages(index: Index, queries: DataFrame, *, query_id: str, text: str, top: int = 5) -> dict[str, DataFrame]:
    """The tables of a search: pairs ``started`` (with a partial score), pairs ``finished``, and the ``best``; see :func:`search`."""
    spark, scope = queries.sparkSession, list(index.scope)
    path = folder(spark, "search")
    words = queries.where(F.col(query_id).isNotNull()).select(*scope, F.col(query_id).alias("query"), F.explode(F.array_distinct(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("term")).distinct()
    key = [*scope, "query"]
    order = Window.partitionBy(*key).orderBy(F.col("top").desc(), "term")  # a query's terms
    ranked = words.join(index.terms, [*scope, "term"]).select(
        *key,
        "term",
        "top",
        F.row_number().over(order).alias("place"),
        F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"),
        F.sum("top").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("onwards"),
    )
    asked = saved(ranked, f"{path}/asked")
    listed = asked.groupBy(*key).agg(F.array_sort(F.collect_list("term")).alias("terms"))

    def finished(pairs: DataFrame) -> DataFrame:
        each = pairs.select(*key, "passage").join(listed, key).join(index.passages, [*scope, "passage"])
        score = F.aggregate("terms", F.lit(0.0), lambda sum_, t: sum_ + F.coalesce(F.try_element_at("impacts", t), F.lit(0.0)))
        return each.select(*key, "passage", _rounded(score).alias("score"))

    def first(scored: DataFrame, by: str, n: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(by).desc(), "passage"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= n)

    rare = asked.where((F.col("upto") <= SEEDS) | (F.col("place") == 1))
    seeds = rare.join(index.postings, [*scope, "term"]).groupBy(*key, "passage").agg(F.sum("impact").alias("part"))
    tried = saved(finished(first(seeds, "part", 4 * top)), f"{path}/tried")
    least = first(tried, "score", top).where(F.col("rank") == top).select(*key, (F.col("score") - 2 / UNIT).alias("least"))
    bound = F.coalesce("least", F.lit(0.0))  # too few seeds: nothing is ruled out
    weighed = saved(asked.join(least, key, "left").withColumn("least", bound).withColumn("matters", F.col("onwards") >= F.col("least") * SHARE), f"{path}/weighed")
    others = F.sum(F.when(F.col("matters"), 0.0).otherwise(index.tops["top"]))
    reach = weighed.drop("top").join(index.tops, [*scope, "term"]).groupBy(*key, "block").agg(F.sum(index.tops["top"]).alias("all"), others.alias("others"), F.first("least").alias("least")).where(F.col("all") >= F.col("least"))
    started = saved(weighed.where("matters").select(*key, "term").join(index.postings, [*scope, "term"]).groupBy(*key, "block", "passage").agg(F.sum("impact").alias("part")), f"{path}/started")
    able = started.join(reach, [*key, "block"]).where(F.col("part") + F.col("others") >= F.col("least"))
    done = saved(finished(able), f"{path}/finished")
    best = first(done, "score", top).select(*scope, F.col("query").alias(query_id), F.col("rank").cast("long").alias("rank"), "passage", "score")
    return {"started": started, "finished": done, "best": best}


def search(index: Index, queries: DataFrame, *, query_id: str, text: str, top: int = 5) -> DataFrame:
    """``scope, query_id, rank, passage, score``: each query's ``top`` passages of its scope (all, if fewer) by BM25 in whole millionths, ties to the smaller passage.

    Only passages with a word of the query are found.  Queries without an id or without words have no rows; rows of one id (and scope) are one query.
    """
    return stages(index, queries, query_id=query_id, text=text, top=top)["best"]


def windows(sources: DataFrame, item: str, text: str, *, words: int = 100) -> DataFrame:
    """``item, passage, text``: runs of ``words`` words of each text, numbered from 0; texts without words have none."""
    w = F.filter(F.split(F.coalesce(column(text), F.lit("")), r"\s+"), lambda x: x != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)), F.lit(words))
    cut = F.transform(starts, lambda i: F.array_join(F.slice("w", i, words), " "))
    return sources.select(item, w.alias("w")).where(F.size("w") > 0).select(item, F.posexplode(cut).alias("passage", "text"))
