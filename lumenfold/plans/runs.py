"""Whole runs: a named table for each, from items to metrics.

A run's folder is ``SOURCE_KIND_HASH`` with a hash of its parameters.  Rows that it has already are skipped by an anti join, so a run that was cut short
goes on where it was; ``overwrite`` starts anew.  Loops over ranges or collections are rows, not processes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranges
from ..operators import assessment, chunking, claims, entities, overlap, summarize
from ..operators.analysis import not_done
from ..providers import Provider, lead, lines
from ..sources.collections import exists
from ..sources.sinks import run_id, save_table


def _stored(spark: SparkSession, out: str, name: str, keys: list[str], wanted: DataFrame, make, overwrite: bool) -> tuple[str, DataFrame]:
    path = f"{out}/{name}"
    if overwrite or not exists(spark, path):
        save_table(make(wanted), path, mode="overwrite")
    else:
        missing = not_done(wanted, spark.read.parquet(path), keys)
        if not missing.isEmpty():
            save_table(make(missing), path, mode="append")
    return name, spark.read.parquet(path)


def chunk_run(items: DataFrame, out: str, source: str, strategy: str, amount: int, *, overwrite: bool = False, **options) -> tuple[str, DataFrame]:
    """``item_id, content`` to ``item_id, chunks, error, stats``."""
    params = {"strategy": strategy, "amount": amount} | options
    make = lambda some: chunking.chunk(some.select("item_id", "content"), strategy, amount, text="content", **options).withColumn("stats", chunking.statistics()).drop("content")
    return _stored(items.sparkSession, out, run_id(source, "chunks", params), ["item_id"], items, make, overwrite)


def summarize_run(chunked: DataFrame, out: str, source: str, strategy: str, *, provider: Provider = lead, prompts: dict[str, str] | None = None, intermediate: bool = True, overwrite: bool = False) -> tuple[str, DataFrame]:
    """``item_id, chunks`` to ``item_id, summary_index, summary``."""
    summarize.check_strategy(strategy, not intermediate)
    p = {"independent": "{text}", "concat": "{text}", "first": "{text}", "later": "{previous_summary}\n{text}"} | (prompts or {})

    def make(some: DataFrame) -> DataFrame:
        if strategy == "no_op":
            return some.select("item_id", F.lit(1).alias("summary_index"), summarize.no_op("chunks").alias("summary"))
        if strategy == "independent":
            return summarize.independent(some, "item_id", "chunks", template=p["independent"], provider=provider)
        if strategy == "concat":
            return summarize.concatenated(some, "item_id", "chunks", intermediate=intermediate, template=p["concat"], provider=provider)
        step = summarize.STRATEGIES[strategy](p["first"], p["later"], provider)
        return summarize.fold(chunking.long_form(some, "item_id"), "item_id", "chunk_index", "chunk", step)

    return _stored(chunked.sparkSession, out, run_id(source, f"summaries_{strategy}", p | {"intermediate": intermediate}), ["item_id"], chunked.where("chunks is not null"), make, overwrite)


def sequences(summaries: DataFrame) -> DataFrame:
    """``item_id, summaries`` with each item's summaries in order."""
    return summaries.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("summary_index", "summary"))).alias("s")).select("item_id", F.transform("s", lambda x: x["summary"]).alias("summaries"))


def overlap_run(summaries: DataFrame, sources: DataFrame, out: str, source: str, *, spec: str = "last", n: int = 1, overwrite: bool = False) -> tuple[str, DataFrame]:
    """Overlap of the selected summary with its item's source text (``item_id, content``); items without one are left out."""

    def make(some: DataFrame) -> DataFrame:
        picked = some.withColumn("r", ranges.select_range("summaries", spec, ranges.SINGLE)).where("r.range_error is null")
        pairs = picked.join(sources.select("item_id", F.col("content").alias("target")), "item_id").select("item_id", "target", F.col("r.text").alias("prediction"))
        return overlap.rouge_n(pairs, n, keys=["item_id"])

    return _stored(summaries.sparkSession, out, run_id(source, "overlap", {"spec": spec, "n": n}), ["item_id"], sequences(summaries), make, overwrite)


def overlap_multi_run(summaries: DataFrame, sources: DataFrame, out: str, source: str, *, most: int | None = None, n: int = 1, overwrite: bool = False) -> tuple[str, DataFrame]:
    """As :func:`overlap_run` for every range of every item, in one job."""
    each = summaries if most is None else summaries.where(F.col("summary_index") <= most)
    each = each.withColumnRenamed("summary_index", "range_num")

    def make(some: DataFrame) -> DataFrame:
        pairs = some.join(sources.select("item_id", F.col("content").alias("target")), "item_id").select("item_id", "range_num", "target", F.col("summary").alias("prediction"))
        return overlap.rouge_n(pairs, n, keys=["item_id", "range_num"])

    return _stored(summaries.sparkSession, out, run_id(source, "overlap-multi", {"n": n, "most": most}), ["item_id", "range_num"], each, make, overwrite)


def continuity_run(summaries: DataFrame, out: str, source: str, *, n: int = 2, all_but_last: bool = False, overwrite: bool = False) -> tuple[str, DataFrame]:
    """Mean overlap of consecutive summaries by item; items with one summary have none."""
    if all_but_last:
        last = summaries.groupBy("item_id").agg(F.max("summary_index").alias("__l"))
        summaries = summaries.join(last, "item_id").where("summary_index < __l").drop("__l")
    make = lambda some: overlap.continuity(some, "item_id", "summary_index", "summary", n=n)
    return _stored(summaries.sparkSession, out, run_id(source, "continuity", {"n": n, "all_but_last": all_but_last}), ["item_id"], summaries, make, overwrite)


def entity_run(summaries: DataFrame, sources: DataFrame, out: str, source: str, *, spec: str = "last", overwrite: bool = False) -> tuple[str, DataFrame]:
    """Entity coverage of the selected summary text: exact, then fuzzy matches."""

    def make(some: DataFrame) -> DataFrame:
        picked = some.withColumn("r", ranges.select_range("summaries", spec, ranges.CLAMPED)).where("r.range_error is null").select("item_id", entities.canonical(entities.recognised("r.text")).alias("a"))
        both = picked.join(sources.select("item_id", entities.canonical(entities.recognised("content")).alias("b")), "item_id")
        pairs = entities.hybrid_pairs(both.select("item_id", F.posexplode("a").alias("ord", "entity")), both.select("item_id", F.posexplode("b").alias("ord", "entity")), "item_id")
        counted = both.join(pairs.groupBy("item_id").agg(F.count("*").alias("pairs")), "item_id", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0).cast("long")))
        return counted.select("item_id", "pairs", F.size("a").alias("n_summary"), F.size("b").alias("n_source"), entities.coverage("pairs", F.size("a"), F.size("b")).alias("coverage"))

    return _stored(summaries.sparkSession, out, run_id(source, "entity-coverage", {"spec": spec}), ["item_id"], sequences(summaries), make, overwrite)


def claims_run(summaries: DataFrame, out: str, source: str, *, provider: Provider = lines, template: str = "{text}", overwrite: bool = False) -> tuple[str, DataFrame]:
    make = lambda some: claims.extracted(some, ["item_id", "summary_index"], "summary", template=template, provider=provider)
    return _stored(summaries.sparkSession, out, run_id(source, "claims", {"template": template}), ["item_id", "summary_index"], summaries, make, overwrite)


def faithfulness_run(extracted: DataFrame, sources: DataFrame, out: str, source: str, *, last_only: bool = False, claim_stop: int | None = None, method: str = "full_text", literal: bool = True, overwrite: bool = False) -> tuple[str, DataFrame]:
    """Faithfulness by summary; range, limits and the way of verification are part of the run's name, so settings don't meet in one folder."""
    if last_only:
        top = extracted.groupBy("item_id").agg(F.max("summary_index").alias("__l"))
        extracted = extracted.join(top, "item_id").where("summary_index = __l").drop("__l")

    def make(some: DataFrame) -> DataFrame:
        each = claims.exploded(some, "item_id", "summary_index", stop=claim_stop)
        told = claims.verified(each, sources.select("item_id", "content"), "item_id", "content", method=method, literal=literal)
        scored = claims.faithfulness(told, "item_id", "summary_index")
        none = some.join(scored.select("item_id", "summary_index"), ["item_id", "summary_index"], "left_anti").select("item_id", "summary_index", F.lit(0).cast("long").alias("claims"), F.lit(0).cast("long").alias("faithful"), F.lit(0.0).alias("strict"), F.lit(0.0).alias("lenient"))
        return scored.unionByName(none)

    return _stored(extracted.sparkSession, out, run_id(source, "faithfulness", {"last_only": last_only, "claim_stop": claim_stop, "method": method, "literal": literal}), ["item_id", "summary_index"], extracted, make, overwrite)


def solve_run(segments: DataFrame, out: str, source: str, *, spec: str, solver: Provider, template: str = "{text}", overwrite: bool = False) -> tuple[str, DataFrame]:
    """``item_id, segments`` to ``item_id, answer, solution``: the selected text in a prompt, the answer's tags parsed."""

    def make(some: DataFrame) -> DataFrame:
        picked = some.withColumn("r", ranges.select_range("segments", spec, ranges.STRICT)).where("r.range_error is null").select("item_id", F.replace(F.lit(template), F.lit("{text}"), F.col("r.text")).alias("prompt"))
        return summarize.called(picked, "prompt", solver, "answer").withColumn("solution", assessment.solution("answer")).drop("prompt")

    return _stored(segments.sparkSession, out, run_id(source, "solved", {"spec": spec, "template": template}), ["item_id"], segments, make, overwrite)


#: The field of a solution that each category of an assessment is about.
SOLVED = {"culprit": "main_culprits", "accomplice": "accomplices"}


def score_run(solved: DataFrame, truth: DataFrame, out: str, source: str, *, judge: Provider, template: str = "{culprit} / {truth}", categories: tuple[str, ...] = ("culprit",), overwrite: bool = False) -> tuple[str, DataFrame]:
    """A judge's assessment of each category, parsed and checked; rescoring is this run with another judge or ``overwrite``."""

    def make(some: DataFrame) -> DataFrame:
        out_df = assessment.ground_truth(some.select("item_id", "solution"), truth, "item_id")
        for c in categories:
            prompt = F.replace(F.replace(F.lit(template), F.lit("{culprit}"), F.col(f"solution.{SOLVED[c]}")), F.lit("{truth}"), F.col(f"{c}s") if f"{c}s" in out_df.columns else F.lit(""))
            out_df = summarize.called(out_df.withColumn("__p", prompt), "__p", judge, f"{c}_answer").drop("__p")
            out_df = out_df.withColumn(c, assessment.parsed_assessment(f"{c}_answer", c)).withColumn(f"{c}_errors", assessment.field_errors(c, c))
        return out_df

    return _stored(solved.sparkSession, out, run_id(source, "scored", {"template": template, "categories": list(categories)}), ["item_id"], solved, make, overwrite)
