"""Claims: extraction from summaries, verification against sources, faithfulness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import column, parse_claims
from ..providers import Provider, lines
from ..sources.scratch import folder
from . import retrieval
from .overlap import tokens
from .summarize import called

#: Labels that mean a claim is faithful.
FAITHFUL = ("yes", "true", "faithful")


def extracted(summaries: DataFrame, keys: list[str], text: str, *, template: str = "{text}", provider: Provider = lines) -> DataFrame:
    """``keys, claims``: a provider's answer to a prompt for each summary, parsed."""
    asked = summaries.select(*keys, F.replace(F.lit(template), F.lit("{text}"), F.col(text)).alias("__prompt"))
    return called(asked, "__prompt", provider, "__answer").select(*keys, parse_claims("__answer").alias("claims"))


def exploded(claims: DataFrame, *keys: str, stop: int | None = None) -> DataFrame:
    """``keys, claim_index, claim``, the first ``stop`` of each summary only if given."""
    some = F.col("claims") if stop is None else F.slice("claims", 1, stop)
    return claims.select(*keys, F.posexplode(some).alias("claim_index", "claim"))


def contained_share(claim: str | Column, source: str | Column) -> Column:
    """Share of a claim's different words that its source has."""
    return _share(F.array_distinct(tokens(column(claim))), tokens(column(source)))


def verified(claims: DataFrame, sources: DataFrame, item: str, source_text: str, *, method: str = "full_text", yes: float = 0.9, partial: float = 0.6, top: int = 3, words: int = 100, literal: bool = False) -> DataFrame:
    """Adds ``predicted_label`` (Yes, PartialSupport or No) and ``faithful`` by words in common; a claim without a source has null ones.

    With ``full_text`` a claim is held against its item's whole source, with ``bm25`` against the ``top`` passages of ``words`` words of that source
    that are most like it.  A claim without words (of ASCII letters or digits) is in no source; with ``literal`` it is in one that has it as it stands.
    Claims and sources are joined by ``item`` of which a source has one row.
    """
    if method == "full_text":
        # a source becomes words once, not for every claim of it
        told = claims.join(sources.select(item, F.array_distinct(tokens(F.col(source_text))).alias("__words")), item, "left")
    elif method == "bm25":
        told = _retrieved(claims, sources, item, source_text, top, words)
    else:
        raise ValueError(f"no method {method}")
    share = _share(F.array_distinct(tokens("claim")), F.col("__words"))
    if literal:
        told = told.join(sources.select(item, F.col(source_text).alias("__source")), item, "left")
        share = F.when((F.size(tokens("claim")) == 0) & (F.col("claim") != "") & F.contains("__source", "claim"), F.lit(1.0)).otherwise(share)
    share = F.when(F.col("__words").isNotNull(), share)
    label = F.when(share >= yes, "Yes").when(share >= partial, "PartialSupport").when(share.isNotNull(), "No")
    return told.withColumn("predicted_label", label).withColumn("faithful", is_faithful("predicted_label")).drop("__words", "__source")


def _share(claim: Column, source: Column) -> Column:
    return F.when(F.size(claim) > 0, F.size(F.array_intersect(claim, source)) / F.size(claim)).otherwise(F.lit(0.0))


def _retrieved(claims: DataFrame, sources: DataFrame, item: str, source_text: str, top: int, words: int) -> DataFrame:
    """Claims with the different words of the passages found for them in their item's source (``__words``)."""
    cut = retrieval.windows(sources, item, source_text, words=words)
    index = retrieval.build(cut, folder(claims.sparkSession, "claims-index"), passage_id="passage", text="text", scope=(item,))
    asked = claims.where(F.col("claim").isNotNull()).select(item, "claim").distinct()
    found = retrieval.search(index, asked, query_id="claim", text="claim", top=top)
    joined = found.join(cut, [item, "passage"]).groupBy(item, "claim").agg(F.array_distinct(F.flatten(F.collect_list(tokens("text")))).alias("__words"))
    known = sources.select(item, F.array().cast("array<string>").alias("__none")).distinct()
    return claims.join(joined, [item, "claim"], "left").join(known, item, "left").withColumn("__words", F.coalesce("__words", "__none")).drop("__none").select(*claims.columns, "__words")


def is_faithful(label: str | Column) -> Column:
    return F.lower(column(label)).isin(*FAITHFUL)


def faithfulness(evaluated: DataFrame, *keys: str) -> DataFrame:
    """``keys, claims, faithful, strict, lenient``: shares of faithful claims, and with partly supported ones."""
    label, n = F.lower("predicted_label"), F.count("predicted_label")
    share = lambda hit: F.coalesce(F.count_if(hit) / F.nullif(n, F.lit(0)), F.lit(0.0))
    yes = label.isin(*FAITHFUL)
    return evaluated.groupBy(*keys).agg(n.alias("claims"), F.count_if(yes).alias("faithful"), share(yes).alias("strict"), share(yes | (label == "partialsupport")).alias("lenient"))


def collection_faithfulness(by_summary: DataFrame, *keys: str) -> DataFrame:
    """Mean over summaries, not claims, and the standard error with the sample's deviation, both in percent."""
    grouped = by_summary.groupBy(*keys) if keys else by_summary.groupBy()
    return grouped.agg(F.count("*").alias("summaries"), (F.avg("strict") * 100).alias("strict"), (F.avg("lenient") * 100).alias("lenient"), (F.stddev_samp("strict") * 100 / F.sqrt(F.count("strict"))).alias("sem"))
