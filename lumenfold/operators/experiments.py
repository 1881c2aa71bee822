"""What compares whole experiments: lookups between runs, methods side by side, checks of one collection against another."""

from __future__ import annotations

import functools
import shlex
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import documents_in
from ..functions.stats import fixed, sem
from ..functions.text import column
from ..providers import Provider
from ..sources.scratch import folder, saved
from .analysis import not_done
from .assessment import option_text
from .containment import contained_in
from .summarize import called

#: Ranges that reports know, and the suffix of a run of claims.
REPORT_RANGES = ("penultimate", "last", "all", "all-but-last", "1")
CLAIMS_SUFFIX = "_claims_default-claim-extraction"
#: Fixed value: what is said of the suspects of a collection without a list of them.
NO_SUSPECTS = "We unfortunately do not have a list of suspects for this story."
#: Options that batches of runs share, by the name of the batch.
PRESETS = {"faithfulness-last": {"range": "last", "claim_stop": 50, "method": "full_text", "add_reveal": True}}


def first_filled(*values: str | Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(column(v), F.lit("")) for v in values])


def with_source(evaluations: DataFrame, collections: DataFrame, *, source: str = "source_collection", name: str = "collection", length: tuple[str, ...] = ("summary_length",)) -> DataFrame:
    """Evaluation runs with the ``length`` of the collection that they name; runs of no or an unknown collection are left out.

    ``length`` are the places where collections keep it, best first; it is null if none is filled.
    """
    named = collections.select(F.col(name).alias("__c"), first_filled(*length).alias("source_length"))
    return evaluations.join(named, F.col(source) == F.col("__c")).drop("__c")


def summary_run_of(name: str | Column, suffix: str = CLAIMS_SUFFIX) -> Column:
    """The name of the summary run that a run of claims was made of."""
    return F.replace(column(name), F.lit(suffix), F.lit(""))


def methods_side_by_side(rows: DataFrame, item: str, position: str, method: str, value: str, pair: tuple[str, str]) -> DataFrame:
    """``position`` and mean, standard error and count of both methods, over items that both have and at positions that both have.

    Other methods' rows and null values don't count.
    """
    some = rows.where(F.col(method).isin(*pair) & F.col(value).isNotNull())
    shared = some.groupBy(item).agg(F.countDistinct(method).alias("__n")).where("__n = 2").select(item)
    told = []
    for m in pair:
        v = F.when(F.col(method) == m, F.col(value))
        told += [F.count(v).alias(f"{m}_n"), F.avg(v).alias(f"{m}_mean"), sem(v).alias(f"{m}_sem")]
    both = some.join(shared, item).groupBy(position).agg(*told)
    return both.where((F.col(f"{pair[0]}_n") > 0) & (F.col(f"{pair[1]}_n") > 0))


def content_split_check(old: DataFrame, new: DataFrame, key: str, *, content: str = "content", reveal: str = "reveal", answer: str = "answer_position") -> DataFrame:
    """``key, status`` of items that both collections have: whether the reveal starts with the line that the answer's number marks.

    ``old`` has the whole numbered text, ``new`` the reveal and the answer's number.  Status is ``same``, ``different`` or ``no such line``.
    """
    whole = old.select(key, F.split(content, "\n", -1).alias("__lines"))
    both = new.select(key, F.split(reveal, "\n", -1)[0].alias("__first"), F.col(answer).alias("__at")).join(whole, key)
    mark = F.concat(F.lit("["), F.col("__at").cast("string"), F.lit("]"))
    line = F.get(F.filter("__lines", lambda x: F.startswith(x, mark)), F.lit(0))
    plain = F.regexp_replace(line, r"^\[\d+\]\s*", "")
    return both.select(key, F.when(line.isNull(), "no such line").when(plain == F.col("__first"), "same").otherwise("different").alias("status"))


def of_ranges(rows: DataFrame, spec: str = "range_spec", ranges: tuple[str, ...] = REPORT_RANGES) -> DataFrame:
    return rows.where(F.col(spec).isin(*ranges))


def positive(rows: DataFrame, value: str) -> DataFrame:
    """Rows with a score over zero; null ones have none."""
    return rows.where(F.col(value) > 0)


def count_distribution(rows: DataFrame, count: str) -> DataFrame:
    """``count, items``: how many items have so many."""
    return rows.groupBy(count).agg(F.count("*").alias("items"))


def questions_by_novel(questions: DataFrame, novel: str, question: str) -> DataFrame:
    """``novel, n, questions`` in alphabetical order, novels with most questions first, then by name."""
    grouped = questions.groupBy(novel).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(question)).alias("questions"))
    return grouped.orderBy(F.col("n").desc(), novel)


#: Characters that count for a word where only lengths are known.
CHARS_A_WORD = 5


def words_by_range(rows: DataFrame, run: str, spec: str, text: str, *, estimated: str | Column | None = None) -> DataFrame:
    """``run, spec, items, words, chars`` (means); where ``estimated`` holds, words are a fifth of the characters."""
    from ..functions.text import word_count

    chars, words = F.length(text), word_count(text).cast("double")
    if estimated is not None:
        words = F.when(column(estimated), chars / CHARS_A_WORD).otherwise(words)
    return rows.groupBy(run, spec).agg(F.count("*").alias("items"), F.avg(words).alias("words"), F.avg(chars).alias("chars"))


def metric_summary(rows: DataFrame, metric: str, value: str, digits: int = 2) -> DataFrame:
    """``metric, n, mean, median, min, max``, rounded; the median is the upper one."""
    v = F.col(value)
    median = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")
    told = {"mean": F.avg(v), "median": median, "min": F.min(v), "max": F.max(v)}
    return rows.where(v.isNotNull()).groupBy(metric).agg(F.count("*").alias("n"), *[fixed(c, digits).alias(name) for name, c in told.items()])


def difference_quality(trusted: DataFrame, other: DataFrame, item: str, a: str = "summary_entity", b: str = "source_entity") -> DataFrame:
    """``item, a, b, side, reasonable`` of matches that only one of two systems has.

    One is reasonable if the other system has a match of the item of which an end holds or is held by the same end; an extra
    one also if its own two ends hold each other without case.   Matches meet within their item only.
    """
    path = folder(trusted.sparkSession, "differences")
    t, o = (saved(x.select(item, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(), f"{path}/{name}") for x, name in ((trusted, "trusted"), (other, "other")))
    sides = (("missing", t, o), ("extra", o, t))
    only = _all(one.join(two, [item, a, b], "left_anti").withColumn("side", F.lit(side)) for side, one, two in sides)
    seen = _all(two.withColumn("side", F.lit(side)) for side, _, two in sides)
    ends = F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col(a).alias("name")), F.struct(F.lit("b").alias("end"), F.col(b).alias("name"))))
    by_end = lambda rows: rows.withColumn("__x", ends).select("*", "__x.*").drop("__x")
    near = contained_in(by_end(only), by_end(seen), "name", "name", by=("side", item, "end"), either_way=True)
    told = only.join(near.select(item, a, b, "side", F.lit(True).alias("__near")).distinct(), [item, a, b, "side"], "left")
    own = F.contains(F.lower(b), F.lower(a)) | F.contains(F.lower(a), F.lower(b))
    good = F.coalesce("__near", F.lit(False)) | ((F.col("side") == "extra") & own)
    return told.select(item, a, b, "side", good.alias("reasonable"))


def _all(tables: Iterable[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def difference_shares(differences: DataFrame) -> DataFrame:
    """``total, reasonable, concerning`` and their percentages; none of nothing."""
    n, good = F.count("*"), F.count_if("reasonable")
    share = lambda x: F.when(n > 0, x / n * 100).otherwise(F.lit(0.0))
    return differences.agg(n.alias("total"), good.alias("reasonable"), (n - good).alias("concerning"), share(good).alias("reasonable_pct"), share(n - good).alias("concerning_pct"))


def in_scope(chunks: DataFrame, scope: str, *, item: str = "item_id", doc_index: str = "doc_index", item_id: str | None = None, doc_range: str | None = None) -> DataFrame:
    """Chunks of the whole ``dataset``, of one ``item``, or of a ``doc_range`` of one; what a scope needs and doesn't get is an error at once."""
    if scope == "dataset":
        return chunks
    if scope not in ("item", "doc_range"):
        raise ValueError(f"unknown scope {scope!r}")
    if not item_id or (scope == "doc_range" and not doc_range):
        raise ValueError(f"scope {scope!r} lacks an argument")
    own = chunks.where(F.col(item) == item_id)
    if scope == "item":
        return own
    from ..functions.ranges import parse_document_range

    return own.where(F.col(doc_index).isin(*parse_document_range(doc_range)))


def documents_of(items: DataFrame, spec: str, documents: str = "documents") -> DataFrame:
    return items.withColumn(documents, documents_in(documents, spec))


def of_items(rows: DataFrame, wanted: Iterable[str], *, item: str = "item_id", strict: bool = False) -> DataFrame:
    """Rows of the items named; with ``strict`` one that isn't there is an error, else it is passed over."""
    names = sorted(set(wanted))
    if strict:
        there = {x[0] for x in rows.where(F.col(item).isin(*names)).select(item).distinct().collect()}
        if lost := [n for n in names if n not in there]:
            raise ValueError(f"no such items: {lost}")
    return rows.where(F.col(item).isin(*names))


def concatenated_documents(documents: DataFrame, item: str, order: str, content: str, delimiter: str = "\n") -> DataFrame:
    """``item, content``: an item's documents as one text, in order, to be chunked as one; null contents are left out."""
    listed = F.sort_array(F.collect_list(F.struct(order, content)))
    return documents.groupBy(item).agg(F.array_join(F.transform(listed, lambda d: d[content]), delimiter).alias(content))


def chunked_item_statistics(documents: DataFrame, item: str, *, chunks: str = "chunks", total_chars: str = "total_chars") -> DataFrame:
    """``item, num_documents, total_chunks, total_chars, avg_chunk_size`` of documents as they are stored.

    Characters are those counted when the text was chunked, chunks those that are there now: an added reveal counts as a chunk but not in the characters.
    """
    n, chars = F.sum(F.coalesce(F.size(chunks), F.lit(0))), F.coalesce(F.sum(total_chars), F.lit(0))
    return documents.groupBy(item).agg(F.count("*").alias("num_documents"), n.alias("total_chunks"), chars.alias("total_chars"), F.when(n > 0, fixed(chars / n, 1)).otherwise(F.lit(0.0)).alias("avg_chunk_size"))


def truth_of(dataset: str, metadata: str | Column, *, answer_options: str | Column | None = None, question: Column | None = None) -> Column:
    """``struct<culprits, culprits_post_reveal, accomplices, suspects, murder_question>`` from an item's own metadata (a map).

    ``true-detective`` names its suspects in ``answer_options``; ``detectiveqa`` has a first ``question`` (a struct with question, answer and options) whose
    answer is the culprit.  ``bmds`` keeps its truth in a table: see :func:`lumenfold.operators.assessment.ground_truth`.
    """
    m = column(metadata)
    at = lambda k: F.try_element_at(m, F.lit(k))
    none = F.lit(None).cast("string")
    out = {"culprits": at("culprit(s), human annotated"), "culprits_post_reveal": at("culprit(s), human annotated--post-reveal"), "accomplices": at("accomplice(s), human annotated"), "suspects": none, "murder_question": none}
    if "true-detective" in dataset.lower() and answer_options is not None:
        out["suspects"] = F.nullif(column(answer_options), F.lit(""))
    elif "detectiveqa" in dataset.lower() and question is not None:
        told = option_text(question["options"], question["answer"])
        out |= {"suspects": F.when(question.isNotNull(), NO_SUSPECTS), "murder_question": F.trim(question["question"])}
        out |= {k: F.coalesce(told, out[k]) for k in ("culprits", "culprits_post_reveal")} | {"accomplices": F.when(told.isNull(), out["accomplices"])}
    return F.struct(*[c.alias(k) for k, c in out.items()])


def to_score(solved: DataFrame, scored: DataFrame, item: str, assessment: str, *, rescore: bool = False) -> DataFrame:
    """Solved items to be scored: those without an assessment, or with ``rescore`` all."""
    return solved if rescore else solved.join(scored.where(F.col(assessment).isNotNull()).select(item).distinct(), item, "left_anti")


def cached(rows: DataFrame, path: str, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table at ``path`` after ``make`` has been asked for the rows whose key it lacks; all else is read."""
    from ..sources.collections import exists

    spark = rows.sparkSession
    missing = not_done(rows, spark.read.parquet(path), keys) if exists(spark, path) else rows
    if not missing.isEmpty():
        make(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def rated(rows: DataFrame, text: str, scorer: Provider, out: str = "score") -> DataFrame:
    """Adds a model's score of a text, a number in its answer; what is none, or no answer, is 0."""
    told = called(rows, text, scorer, "__told")
    return told.withColumn(out, F.coalesce(F.trim("__told").try_cast("double"), F.lit(0.0))).drop("__told")


def command(arguments: list[str], module: str | None = None) -> str:
    """The command line that a run was started with; a module's own file is told as ``python -m``."""
    first = f"python -m {module}" if module and arguments[0].endswith("__main__.py") else shlex.quote(arguments[0])
    return " ".join([first, *arguments[1:]])


def fanned_out(names: Iterable[str], run: Callable[[str], object], *, stop_at_failure: bool = False) -> dict[str, str | None]:
    """Runs one after the other, by name: null or what went wrong; with ``stop_at_failure`` the first failure ends it all.

    Only for runs that differ in more than their rows: what is the same run on other items is one frame.
    """
    out: dict[str, str | None] = {}
    for name in names:
        try:
            run(name)
            out[name] = None
        except Exception as e:  # noqa: BLE001  a failed run is counted
            if stop_at_failure:
                raise
            out[name] = f"{type(e).__name__}: {e}"
    return out


def underscored_keys(json_text: str | Column) -> Column:
    """JSON text with ``_`` for each ``-`` in keys, at any depth; values stay (keys with escaped characters aren't looked into)."""
    return F.regexp_replace(column(json_text), r'-(?=[^"\\]*"\s*:)', "_")
