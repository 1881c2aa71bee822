"""Summaries over ordered chunks: one call, one for each chunk, growing prefixes, and folds that carry the last summary on.

A model is a provider: a plain function of prompts, called with batches.  The default is deterministic and needs no
network: the first sentences of the text within the prompt's marks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import column, filled
from ..providers import Provider, lead

SUMMARY = "array<struct<summary_index:int,summary:string>>"


def no_op(chunks: str | Column) -> Column:
    return F.array_join(column(chunks), "\n\n")


def prefixes(chunks: str | Column) -> Column:
    """For each step the chunks up to it, joined."""
    c = column(chunks)
    return F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))), lambda k: F.array_join(F.slice(c, 1, k), "\n\n"))).otherwise(F.array().cast("array<string>"))


def prefixes_long(chunks: DataFrame, item: str, step: str, text: str) -> DataFrame:
    """As :func:`prefixes`, of one row for each chunk."""
    w = Window.partitionBy(item).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.select(item, step, F.array_join(F.collect_list(text).over(w), "\n\n").alias("prefix"))


def called(df: DataFrame, prompt: str, provider: Provider = lead, out: str = "answer") -> DataFrame:
    """Adds the provider's answers to a column of prompts, batch by batch; null prompts have null answers."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch[prompt].notna()
            batch[out] = None
            if asked.any():
                batch.loc[asked, out] = provider(batch.loc[asked, prompt].tolist())
            yield batch

    return df.mapInPandas(run, schema)


PROMPT = "{text}"


def independent(items: DataFrame, item: str, chunks: str, *, template: str = PROMPT, provider: Provider = lead) -> DataFrame:
    """``item, summary_index, summary``: a call for each chunk."""
    each = items.select(item, F.posexplode(chunks).alias("i", "text"))
    asked = each.select(item, (F.col("i") + 1).alias("summary_index"), filled(template, {"text": F.col("text")}).alias("prompt"))
    return called(asked, "prompt", provider, "summary").drop("prompt")


def concatenated(items: DataFrame, item: str, chunks: str, *, intermediate: bool = False, template: str = PROMPT, provider: Provider = lead) -> DataFrame:
    """One call over all chunks, or with ``intermediate`` one for each step over the chunks up to it."""
    texts = prefixes(chunks) if intermediate else F.when(F.size(chunks) > 0, F.array(no_op(chunks))).otherwise(F.array().cast("array<string>"))
    each = items.select(item, F.posexplode(texts).alias("i", "text"))
    asked = each.select(item, (F.col("i") + 1).alias("summary_index"), filled(template, {"text": F.col("text")}).alias("prompt"))
    return called(asked, "prompt", provider, "summary").drop("prompt")


Step = Callable[[str | None, str], str]


def fold(chunks: DataFrame, item: str, step: str, text: str, summary: Step) -> DataFrame:
    """``item, summary_index, summary``: each step's summary is made of its chunk and the summary before it.

    ``summary`` takes the last summary (None at first) and the chunk.  An item's steps are one sequence and run in one task, streamed in order; items
    are spread by key, so no whole group is held in memory.
    """
    kind = chunks.schema[item].dataType
    schema = T.StructType([T.StructField(item, kind), T.StructField("summary_index", T.IntegerType()), T.StructField("summary", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, before, k = object(), None, 0
        for batch in batches:
            rows = []
            for name, chunk in zip(batch[item], batch[text], strict=True):
                if name != last:
                    last, before, k = name, None, 0
                before, k = summary(before, chunk or ""), k + 1
                rows.append((name, k, before))
            if rows:
                yield pd.DataFrame(rows, columns=schema.names)

    ordered = chunks.select(item, step, text).where(F.col(item).isNotNull()).repartition(item).sortWithinPartitions(item, step)
    return ordered.mapInPandas(run, schema)


def iterative(first: str, later: str, provider: Provider = lead) -> Step:
    """A cumulative summary: the first chunk has a prompt of its own, later ones get the last summary too."""

    def step(before: str | None, chunk: str) -> str:
        prompt = first if before is None else later.replace("{previous_summary}", before)
        return provider([prompt.replace("{text}", chunk)])[0]

    return step


def update_incremental(first: str, later: str, provider: Provider = lead) -> Step:
    """As :func:`iterative`, for prompts that ask what the chunk adds; asking for the final one only is an error at once."""
    return iterative(first, later, provider)


STRATEGIES = {"no_op": no_op, "independent": independent, "concat": concatenated, "iterative": iterative, "update-incremental": update_incremental}


def check_strategy(name: str, final_only: bool) -> None:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; there are {sorted(STRATEGIES)}")
    if final_only and name in ("iterative", "update-incremental"):
        raise ValueError(f"{name} makes every step's summary; ask for intermediate ones")


def lead_fold(chunks: str | Column, keep: int = 40) -> Column:
    """The iterative summary of a deterministic summariser, as a fold of expressions: the last ``keep`` characters of summary, blank, chunk start."""
    return F.aggregate(
        column(chunks),
        F.array().cast("array<string>"),
        lambda done, c: F.array_append(done, F.substring(F.concat(F.substring(c, 1, keep), F.lit(" "), F.coalesce(F.get(done, F.size(done) - 1), F.lit(""))), 1, 2 * keep)),
    )


def run_name(prompt: str, model: str, length: str, final_only: bool) -> str:
    return hashlib.md5("|".join((prompt, model, length, "final" if final_only else "intermediate")).encode()).hexdigest()[:6]


def usage_rollup(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls, tokens and cost by item or run."""
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens", "total_cost")])
