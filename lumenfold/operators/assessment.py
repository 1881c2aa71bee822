"""Solving and scoring: answers parsed from tagged text, assessments from JSON sections, checked field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import column, tagged

#: The fields of a solution and their tags.
SOLUTION_TAGS = {
    "thought_process": "THOUGHT PROCESS",
    "suspects": "SUSPECTS",
    "main_culprits": "MAIN CULPRIT(S)",
    "accomplices": "ACCOMPLICE(S)",
    "event_reconstruction": "EVENT RECONSTRUCTION",
    "why_others_innocent": "WHY THE OTHER SUSPECTS ARE INNOCENT",
}
#: The fields of each section of an assessment.
FIELDS = {
    "culprit": {
        "assessment": ("culprit_correct",),
        "minor_errors": ("culprit_missing_or_wrong_alias", "hallucinated_part_of_name", "missing_part_of_name", "included_accomplice"),
        "major_errors": ("different_suspect_not_accomplice", "confused_swapped_culprit_and_accomplice", "missing_real_name_only_has_alias", "included_other_non_accomplice_suspects"),
    },
    "accomplice": {
        "assessment": ("accomplice_correct",),
        "minor_errors": ("accomplice_missing_or_wrong_alias", "hallucinated_part_of_name", "missing_part_of_name", "included_culprit"),
        "major_errors": ("different_suspect_not_culprit", "confused_swapped_accomplice_and_culprit", "missing_real_name_only_has_alias", "included_other_non_culprit_suspects"),
    },
}
MAP = "map<string,string>"


def solution(text: str | Column, tags: dict[str, str] | None = None) -> Column:
    """A struct of what stands in each tag, by field name; empty if it isn't there."""
    return F.struct(*[tagged(text, tag).alias(name) for name, tag in (tags or SOLUTION_TAGS).items()])


def json_section(text: str | Column, *headers: str, field: str | None = None) -> Column:
    """The JSON object after a header (fenced or not) as a map; the last pattern that matches wins.

    Patterns are the headers in order and, if ``field`` is given, any object that has the field.  Comments and trailing commas are
    taken off; hyphens in keys become underscores.  Null if nothing is found or it isn't JSON.
    """
    t = column(text)
    patterns = [r"(?is)" + h + r":\s*(?:```json\s*)?(\{.*?\})" for h in headers]
    if field:
        patterns.append(r'(?is)(\{[^}]*"' + field + r'"[^}]*\})')
    out = F.lit(None).cast(MAP)
    for p in patterns:
        found = F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
        clean = F.regexp_replace(F.regexp_replace(found, r"#[^\n]*|//[^\n]*", ""), r",\s*([}\]])", "$1")
        out = F.coalesce(F.from_json(clean, MAP), out)
    return F.transform_keys(out, lambda k, _: F.replace(k, F.lit("-"), F.lit("_")))


def parsed_assessment(text: str | Column, category: str) -> Column:
    """``struct<assessment, minor_errors, major_errors>`` of maps."""
    name = category.upper()
    parts = {"assessment": "ASSESSMENT", "minor_errors": "MINOR ERRORS", "major_errors": "MAJOR ERRORS"}
    return F.struct(*[json_section(text, f"{name} {head}", rf"(?:{name}\s+)?{head}", field=FIELDS[category][part][0]).alias(part) for part, head in parts.items()])


def field_errors(parsed: str | Column, category: str) -> Column:
    """Missing and unexpected fields of each section; none if the assessment is as it should be."""
    p = column(parsed)
    out = []
    for part, names in FIELDS[category].items():
        expected, keys = F.array(*map(F.lit, names)), F.map_keys(p[part])
        out.append(F.when(p[part].isNull(), F.array(F.lit(f"no {category} {part}"))).otherwise(F.concat(_named("missing ", F.array_except(expected, keys)), _named("unexpected ", F.array_except(keys, expected)))))
    return F.concat(*out)


def _named(prefix: str, names: Column) -> Column:
    return F.transform(names, lambda k: F.concat(F.lit(prefix), k))


def flattened(assessments: DataFrame, item: str, category: str, parsed: str) -> DataFrame:
    """``item, field, value``: a row for each field, named ``category_severity_field`` (the main one by its own name)."""
    p = F.col(parsed)
    none = F.create_map().cast(MAP)
    minor, major = (F.transform_keys(F.coalesce(p[f"{s}_errors"], none), _prefixed(f"{category}_{s}_")) for s in ("minor", "major"))
    return assessments.select(item, F.explode(F.map_concat(F.coalesce(p["assessment"], none), minor, major)).alias("field", "value"))


def _prefixed(prefix: str):
    return lambda k, _: F.concat(F.lit(prefix), k)


def compared(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``keys, left_value, right_value, status`` of all fields: same, different, left_only or right_only; absent ones are MISSING.

    ``N/A`` and ``No`` mean the same.
    """
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("__l"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("__r"))
    both = a.join(b, keys, "full")
    plain = lambda c: F.when(F.col(c) == "N/A", "No").otherwise(F.col(c))
    status = F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").when(plain("left_value").eqNullSafe(plain("right_value")), "same").otherwise("different")
    return both.select(*keys, F.coalesce("left_value", F.lit("MISSING")).alias("left_value"), F.coalesce("right_value", F.lit("MISSING")).alias("right_value"), status.alias("status"))


def agreement(comparison: DataFrame, *keys: str) -> DataFrame:
    shared = comparison.where(F.col("status").isin("same", "different"))
    return shared.groupBy(*keys).agg(F.count("*").alias("fields"), (F.count_if(F.col("status") == "same") / F.count("*")).alias("agreement"))


def accuracy(assessments: DataFrame, *keys: str, culprit: str = "culprit", accomplice: str = "accomplice") -> DataFrame:
    """Shares of culprits, accomplices and both right; rows without an assessment don't count."""
    c, a = F.col(culprit) == "Yes", F.col(accomplice) == "Yes"
    share = lambda x: F.avg(F.coalesce(x, F.lit(False)).cast("int"))
    return assessments.where(F.col(culprit).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), share(c).alias("culprit_accuracy"), share(a).alias("accomplice_accuracy"), share(c & a).alias("both_accuracy"))


def culprit_of(pre: str | Column, post: str | Column, spec: str) -> Column:
    """The culprit after the reveal if the range reaches it and there is one, else the one before."""
    p, q = column(pre), column(post)
    return F.when(F.nullif(q, F.lit("")).isNotNull(), q).otherwise(p) if spec in ("last", "all") else p


def ground_truth(items: DataFrame, truth: DataFrame, item: str, *, key: str = "story_id") -> DataFrame:
    """Items with their external truth (left join); empty, N/A and absent cells become ``None``."""
    cells = [c for c in truth.columns if c != key]
    clean = truth.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in cells])
    joined = items.join(clean, F.col(item) == F.col("__k"), "left").drop("__k")
    for c in cells:
        v = F.nullif(F.nullif(F.trim(f"__{c}"), F.lit("")), F.lit("N/A"))
        joined = joined.withColumn(c, F.coalesce(v, F.lit("None"))).drop(f"__{c}")
    return joined


def option_text(options: str | Column, answer: str | Column) -> Column:
    """The text of the option that a letter names, without a leading ``A - ``."""
    o, a = column(options), column(answer)
    return F.regexp_replace(F.try_element_at(o, a), r"^[A-D]\s*-\s*", "")
