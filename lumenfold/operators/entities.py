"""Entities: recognition, exact and fuzzy matching, coverage."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import capitalised_names, column, normalize_entity
from . import alike

#: Labels of entities that count.
LABELS = ("PERSON", "ORG", "GPE", "PRODUCT", "EVENT", "FAC", "WORK_OF_ART")
#: Items with more entities than this aren't grouped by a model.
MOST_ENTITIES = 1000
SIMILAR = 0.8


def recognised(text: str | Column) -> Column:
    """Entities of a text by the offline recogniser: capitalised names, each once in order."""
    return capitalised_names(F.regexp_replace(column(text), "\n", " "))


def recognised_in_windows(text: str | Column, width: int = 1_000_000) -> Column:
    """As :func:`recognised`, window by window, for texts that a recogniser wouldn't take whole; a name cut by a border may come in parts."""
    t = column(text)
    n = F.greatest(F.ceil(F.length(t) / width), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: recognised(F.substring(t, k * width + 1, F.lit(width))))
    return F.array_distinct(F.flatten(parts))


def of_labels(entities: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """Names (longer than a letter, each once in order) of structs of ``text`` and ``label``."""
    kept = F.filter(entities, lambda e: e["label"].isin(*labels) & (F.length(F.trim(e["text"])) > 1))
    return F.array_distinct(F.transform(kept, lambda e: F.trim(e["text"])))


def _with_norms(names: Column, then) -> Column:
    """``then(normalised names)``, with these made once."""
    return F.get(F.transform(F.array(F.transform(names, lambda x: normalize_entity(x))), then), F.lit(0))


def grouped(entities: str | Column) -> Column:
    """Canonical names: those that are alike without case, accents and so on become the first of them (map of name to canonical)."""
    e = F.array_distinct(column(entities))
    return _with_norms(e, lambda norms: F.map_from_arrays(e, F.transform(norms, lambda n: F.get(e, F.array_position(norms, n).cast("int") - 1))))


def canonical(entities: str | Column) -> Column:
    """The canonical names only; more than :data:`MOST_ENTITIES` stay as they are."""
    e = F.array_distinct(column(entities))
    first = _with_norms(e, lambda norms: F.filter(e, lambda _, i: F.array_position(norms, F.get(norms, i)) == i + 1))
    return F.when(F.size(e) > MOST_ENTITIES, e).otherwise(first)


def exact_pairs(summary: DataFrame, source: DataFrame, item: str, entity: str = "entity") -> DataFrame:
    """``item, summary_entity, source_entity`` of equal normalised names; of several source names the last one is taken.

    Inputs have ``item``, ``ord`` (place) and the entity.
    """
    s = source.select(item, normalize_entity(entity).alias("norm"), F.struct("ord", F.col(entity).alias("e")).alias("x")).groupBy(item, "norm").agg(F.max("x").alias("x"))
    return summary.select(item, F.col(entity).alias("summary_entity"), normalize_entity(entity).alias("norm")).join(s, [item, "norm"]).select(item, "summary_entity", F.col("x.e").alias("source_entity"))


def fuzzy_pairs(summary: DataFrame, source: DataFrame, item: str, entity: str = "entity", similar: float = SIMILAR) -> DataFrame:
    """Each summary entity's most similar source entity of its item from ``similar`` on; ties go to the earlier one.

    Different normal forms meet by a similarity join (:mod:`alike`), so a large item isn't compared all with all.
    """
    a = summary.select(item, F.col(entity).alias("summary_entity"), normalize_entity(entity).alias("a"))
    b = source.select(item, normalize_entity(entity).alias("b"), F.struct("ord", F.col(entity).alias("source_entity")).alias("x"))
    near = alike.pairs(a, b, by=[item], a="a", b="b", similar=similar)
    # of a normal form the earliest entity stands for all
    scored = near.join(b.groupBy(item, "b").agg(F.min("x").alias("x")), [item, "b"]).groupBy(item, "a").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "x")).alias("best"))
    return a.join(scored, [item, "a"]).select(item, "summary_entity", F.col("best.x.source_entity").alias("source_entity"), (-F.col("best.r")).alias("ratio"))


def hybrid_pairs(summary: DataFrame, source: DataFrame, item: str, entity: str = "entity", matcher=None) -> DataFrame:
    """Exact matches, fuzzy ones of the rest, and a matcher's (a function of rest and source to pairs) of what is left; cheap ones first."""
    exact = exact_pairs(summary, source, item, entity).withColumn("how", F.lit("exact"))
    rest = _without(summary, exact, item, entity)
    fuzzy = fuzzy_pairs(rest, source, item, entity).drop("ratio").withColumn("how", F.lit("fuzzy"))
    out = exact.unionByName(fuzzy)
    if matcher is None:
        return out
    told = matcher(_without(rest, fuzzy, item, entity), source)
    known = source.select(F.col(item).alias("__i"), F.col(entity).alias("__e")).distinct()
    real = told.join(known, (told[item] == F.col("__i")) & (told["source_entity"] == F.col("__e")), "left_semi")  # made-up names don't count
    return out.unionByName(real.select(item, "summary_entity", "source_entity").withColumn("how", F.lit("model")))


def _without(summary: DataFrame, pairs: DataFrame, item: str, entity: str) -> DataFrame:
    done = pairs.select(F.col(item).alias("__i"), F.col("summary_entity").alias("__e"))
    return summary.join(done, (F.col(item) == F.col("__i")) & (F.col(entity) == F.col("__e")), "left_anti")


def coverage(pairs: str | Column, n_summary: str | Column, n_source: str | Column) -> Column:
    """``struct<jaccard, recall, precision>`` of a number of matched pairs; zero denominators give zero."""
    p, a, b = column(pairs), column(n_summary), column(n_source)
    share = lambda d: F.when(d > 0, p / d).otherwise(F.lit(0.0))
    return F.struct(share(a + b - p).alias("jaccard"), share(b).alias("recall"), share(a).alias("precision"))


def source_only(source: str | Column, matched: str | Column) -> Column:
    """Source entities that no pair has; repeated ones stay."""
    m = column(matched)
    return F.filter(column(source), lambda x: ~F.array_contains(m, x))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Similarity by longest matching blocks, as the standard library defines it; it depends on the order of the two."""
    for a, b in batches:
        yield pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def similar_names(names: DataFrame, block: list[str], name: str, order: str, similar: float = 0.7) -> DataFrame:
    """``block, i, j, a, b, ratio``: pairs of rows of a block (a novel, say) whose names are alike, the row first in ``order`` first.

    Matching blocks are a common subsequence, so candidates are pairs of different names that have one long enough (:mod:`alike`); blocks are found for these alone.
    Null names have no pairs.
    """
    rows = names.where(F.col(name).isNotNull()).select(*block, F.col(name).alias("x"), F.col(order).alias("k"))
    near = alike.pairs(rows, rows, by=block, a="x", b="x", similar=similar).withColumn("ratio", sequence_ratio("a", "b")).where(F.col("ratio") >= similar)
    one, two = (rows.select(*block, F.col("x").alias(x), F.col("k").alias(k)) for x, k in (("a", "i"), ("b", "j")))
    return near.join(one, [*block, "a"]).join(two, [*block, "b"]).where("i < j").select(*block, "i", "j", "a", "b", "ratio")
