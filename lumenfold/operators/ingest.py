"""Ingestion of question-annotated novels and of passages with reference summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cleaned_option, corrected, mapped, split_at_line, word_count
from .entities import similar_names

#: Words and phrases of questions about who did it, for :func:`lumenfold.functions.text.keyword_question`; what else to allow or block
#: is a matter of the corpus.
CULPRIT_KEYWORDS = [
    "murderer", "killer", "culprit", "perpetrator", "criminal",
    "who killed", "who murdered", "who committed", "who did it",
    "who is responsible", "who was the", "guilty person", "suspect",
]
#: A question counts from this share of a novel's numbered lines on.
LATE = 0.85


def numbered_lines(text: str | Column) -> Column:
    """Lines that start with a bracketed number."""
    t = F.col(text) if isinstance(text, str) else text
    return F.size(F.filter(F.split(t, "\n"), lambda x: F.ltrim(x).startswith("[") & F.contains(x, F.lit("]"))))


def questions(annotations: DataFrame) -> DataFrame:
    """A row for each question: ``novel_id, time_cost, num_paragraphs, ord`` and the question's fields.

    ``ord`` is the place in a novel's order: by time cost, then paragraphs, then place in the file.
    """
    each = annotations.select("novel_id", F.coalesce("time_cost", F.lit(0)).alias("time_cost"), F.coalesce("num_paragraphs", F.lit(0)).alias("num_paragraphs"), F.posexplode("questions").alias("n", "q"))
    w = Window.partitionBy("novel_id").orderBy("time_cost", "num_paragraphs", "n", F.col("q.question"))
    return each.select("novel_id", "time_cost", "num_paragraphs", F.row_number().over(w).alias("ord"), "q.*")


def near_duplicates(rows: DataFrame, similar: float = 0.8) -> DataFrame:
    """Questions of a novel that are like an earlier one (``novel_id, i, a, j, b, ratio``, over ``similar``): a report, nothing is dropped."""
    found = similar_names(rows, ["novel_id"], "question", "ord", similar).where(F.col("ratio") > similar)
    return found.select("novel_id", "i", "a", "j", "b", "ratio")


def novel_items(
    novels: DataFrame,
    annotations: DataFrame,
    wanted: Callable[[Column], Column],
    *,
    english: Callable[[Column], Column] = lambda q: q.rlike(r"^[\x00-\x7f]*$"),
    exclude: tuple[int, ...] = (),
    question_map: dict[str, str] | None = None,
    answer_map: dict[str, str] | None = None,
    names: dict[str, str] | None = None,
    split: bool = True,
) -> DataFrame:
    """``novel_id, title, content, reveal, questions`` of novels with a wanted question late enough in the text.

    The first such question's answer position splits content from reveal; a novel without numbered lines has no position filter.
    Novels without such questions, and excluded ones, have no row.
    """
    q = questions(annotations).where(~F.col("novel_id").isin(*exclude) if exclude else F.lit(True))
    q = q.where(english(F.col("question")) & wanted(F.col("question")))
    q = q.withColumn("question", mapped(F.trim("question"), question_map or {})).withColumn("options", F.transform_values("options", lambda _, v: mapped(cleaned_option(v), answer_map or {})))
    n = novels.select("novel_id", "title", "text").withColumn("lines", numbered_lines("text"))
    late = q.join(n.select("novel_id", "lines"), "novel_id").where((F.col("lines") == 0) | (F.coalesce("answer_position", F.lit(0)) / F.col("lines") >= LATE))
    listed = late.groupBy("novel_id").agg(F.array_sort(F.collect_list(F.struct("ord", "question", "answer", "answer_position", "options")), lambda a, b: a["ord"] - b["ord"]).alias("questions"))
    out = n.join(listed, "novel_id")
    if not split:
        return out.select("novel_id", "title", corrected("text", names or {}).alias("content"), F.lit(None).cast("string").alias("reveal"), "questions")
    parts = split_at_line("text", F.get("questions", F.lit(0))["answer_position"])
    return out.withColumn("p", parts).select("novel_id", "title", corrected("p.content", names or {}).alias("content"), corrected("p.reveal", names or {}).alias("reveal"), "questions")


def passage_items(passages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """``item_id, doc_id, content, metadata`` of passages (``document, metadata, questions, split``), titles from a side table if there is one."""
    made = passages.withColumn("item_id", F.col("metadata.passage_id").cast("string"))
    if titles is None:
        made = made.withColumn("title", F.lit("")).withColumn("author", F.lit(""))
    else:
        side = titles.select(F.col("passage_id").cast("string").alias("__p"), F.col("title").alias("__t"), F.col("author").alias("__a"))
        made = made.join(side, F.col("item_id") == F.col("__p"), "left").withColumn("title", F.coalesce("__t", F.lit(""))).withColumn("author", F.coalesce("__a", F.lit("")))
    told = F.transform("questions", lambda q: F.struct(q["question_text"].alias("question_text"), q["question_number"].alias("question_number"), q["responses"].alias("responses")))
    meta = F.struct("title", "author", F.col("item_id").alias("passage_id"), F.col("metadata.uid").alias("uid"), F.col("metadata.license").alias("license"), "split", told.alias("questions"), F.size("questions").alias("num_questions"), word_count("document").alias("document_length_words"), F.length("document").alias("document_length_chars"))
    return made.select("item_id", F.col("item_id").alias("doc_id"), F.col("document").alias("content"), meta.alias("metadata"))
