"""Scalar text functions, all column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading words that entity names lose, tried in this order.
DETERMINERS = ("the ", "a ", "an ", "la ", "le ", "il ", "el ", "los ", "las ")
#: Headers that are not claims.
CLAIM_HEADERS = ("claims:", "claims", "extracted claims:")
#: Capitalised words that are no names.
NOT_NAMES = (
    "The", "A", "An", "This", "That", "These", "Those", "Who", "What", "Where",
    "When", "Why", "How", "Which", "Mr", "Mrs", "Ms", "Dr", "Professor", "Sir",
    "Lady", "Lord", "Captain", "Colonel", "Detective", "Inspector", "Officer",
    "According", "Based", "Following", "Question", "Answer", "Text", "Story",
    "Novel", "Book", "Chapter", "Scene", "Case", "Murder", "Killer", "Murderer",
    "Victim", "Suspect", "Culprit", "Criminal", "Person", "People", "Someone",
    "Everyone", "Anyone", "Nobody", "Somebody", "Something", "Nothing", "Everything",
)
#: Words that the person-name test refuses.
NOT_PERSONS = (
    "The", "A", "An", "This", "That", "These", "Those", "Who", "What",
    "Where", "When", "Why", "How", "Which", "Yes", "No", "Oh", "Ah",
    "Mr", "Mrs", "Ms", "Dr", "Professor", "Sir", "Lady", "Lord",
    "Captain", "Colonel", "Detective", "Inspector", "Officer",
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)
#: Fixed value: what a capitalised name looks like.
NAME_PATTERN = r"\b[A-Z][a-zA-Z]*(?:'s?|\-[A-Z][a-zA-Z]*)*(?:\s+[A-Z][a-zA-Z]*(?:'s?|\-[A-Z][a-zA-Z]*)*)*\b"
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēėęěğīįłńňōőřśšťūůűųźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeegiilnnoorsstuuuuzzz"
assert len(_ACCENTED) == len(_PLAIN)


def column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def transliterated(x: str | Column) -> Column:
    """Lower case without the accents of Latin letters; ß, æ and œ become two letters."""
    out = F.translate(F.lower(column(x)), _ACCENTED, _PLAIN)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("đ", "d"), ("’", "'")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize_entity(x: str | Column) -> Column:
    """An entity's name for comparison: no case, accents, possessive, leading determiner or punctuation; ``&`` is ``and``."""
    out = F.regexp_replace(transliterated(x), r"'s$", "")
    out = F.replace(out, F.lit("&"), F.lit("and"))
    out = F.regexp_replace(out, "^(?:" + "|".join(DETERMINERS) + ")", "")
    out = F.regexp_replace(out, r"[^\w\s]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def words(x: str | Column) -> Column:
    """The words between white space of any kind."""
    return F.filter(F.split(column(x), r"(?U)\s+", -1), lambda w: w != "")


def word_count(x: str | Column) -> Column:
    return F.size(words(x))


def parse_claims(response: str | Column) -> Column:
    """The claims of a bulleted or numbered answer, a line each, without bullets, numbers, headers and empty lines."""
    lines = F.split(F.trim(column(response)), "\n")

    def bare(line: Column) -> Column:
        line = F.regexp_replace(F.regexp_replace(line, r"^\s+|\s+$", ""), r"^[- *•]+", "")
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"^\s+|\s+$", ""), r"^\d+\.\s*", ""), r"^\s+|\s+$", "")

    return F.filter(F.transform(lines, bare), lambda c: (c != "") & ~F.lower(c).isin(*CLAIM_HEADERS))


def tagged(x: str | Column, tag: str) -> Column:
    """What stands in the first pair of a tag, in any case and over lines; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(column(x), f"(?is)\\Q<{tag}>\\E(.*?)\\Q</{tag}>\\E", 1), r"^\s+|\s+$", "")


def answer_after(x: str | Column, label: str = "ANSWER:") -> Column:
    """The rest of the line after a label, else the first line."""
    text = column(x)
    found = F.trim(F.regexp_extract(text, f"(?i){label}\\s*([^\\n]*)", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.trim(F.substring_index(text, "\n", 1)))


def short_constraint(x: str | Column, *, unconstrained: str | None = None, summary_first: bool = False) -> Column:
    """The short form of a length constraint: ``<50`` to ``<1000``, ``long``, ``summary``, ``<N``, or its first ten characters.

    ``unconstrained`` names those without a limit in the dialects that have such a name; with ``summary_first`` any
    text with "summary" is one whatever numbers it has.
    """
    text = column(x)
    low = F.lower(text)
    number = F.regexp_extract(low, r"(\d+)\s*words?", 1)
    out = F.when(text.isNull() | (text == ""), "unknown")
    if unconstrained is not None:
        out = out.when(low.isin("none", "no constraint", "unconstrained"), unconstrained)
    if summary_first:
        out = out.when(F.contains(low, F.lit("summary")), "summary")
    for n in (50, 100, 200, 500, 1000):
        out = out.when(F.contains(low, F.lit(f"less than {n} words")), f"<{n}")
    out = out.when(F.contains(low, F.lit("very long")), "long")
    out = out.when(F.contains(low, F.lit("summary")) & ~F.contains(low, F.lit("word")), "summary")
    out = out.when(number != "", F.concat(F.lit("<"), number))
    return out.otherwise(F.when(F.length(text) > 10, F.concat(F.substring(text, 1, 10), F.lit("..."))).otherwise(text))


CONSTRAINT_ORDER = ("<50", "<100", "<200", "<500", "<1000", "long", "summary")


def constraint_rank(x: str | Column) -> Column:
    """Place in the usual order of constraints; unknown ones come last."""
    place = F.array_position(F.array(*map(F.lit, CONSTRAINT_ORDER)), column(x))
    return F.when(place > 0, place).otherwise(F.lit(len(CONSTRAINT_ORDER) + 1))


def without_line_number(line: str | Column) -> Column:
    return F.regexp_replace(column(line), r"^\[\d+\]\s*", "")


def split_at_line(text: str | Column, position: str | Column, delimiter: str = "\n") -> Column:
    """``struct<content, reveal>``: lines before the given one (from 1), and from it on; line numbers in brackets are taken off."""
    lines = F.transform(F.split(column(text), delimiter, -1), without_line_number)
    at = F.greatest(column(position), F.lit(1))
    return F.struct(F.array_join(F.slice(lines, 1, at - 1), delimiter).alias("content"), F.array_join(F.filter(lines, lambda _, i: i >= at - 1), delimiter).alias("reveal"))


def corrected(text: str | Column, names: dict[str, str]) -> Column:
    """Names replaced in the order given: phrases wherever they are, single words at word boundaries."""
    out = column(text)
    for old, new in names.items():
        if " " in old:
            out = F.replace(out, F.lit(old), F.lit(new))
        else:
            out = F.regexp_replace(out, "\\b\\Q" + old + "\\E\\b", new.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def occurrences(text: str | Column, part: str | Column, *, fold_case: bool = True) -> Column:
    """Non-overlapping occurrences of a part; an empty part occurs nowhere."""
    text, part = column(text), F.lit(part) if isinstance(part, str) else part
    if fold_case:
        text, part = F.lower(text), F.lower(part)
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, F.floor(gone / F.length(part))).otherwise(F.lit(0)).cast("long")


def snippet(text: str | Column, part: str, around: int = 50) -> Column:
    """The first occurrence with so many characters before and after it; null if there is none."""
    text = column(text)
    at = F.locate(part, text) if isinstance(text, str) else F.instr(text, part)
    begin = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, begin, at - begin + len(part) + around))


def cleaned_option(x: str | Column) -> Column:
    """An answer option without a translator's remark; a long one with quotation marks is its first word."""
    text = F.trim(column(x))
    remark = F.contains(text, F.lit(': "')) & F.contains(text, F.lit('(Translation: "I\'m here to listen'))
    first = F.regexp_replace(F.get(words(text), F.lit(0)), "^[ \"']+", "")
    return F.when(remark, F.trim(F.substring_index(text, ":", 1))).when((F.length(text) > 50) & F.contains(text, F.lit('"')), first).otherwise(text)


def mapped(x: str | Column, values: dict[str, str]) -> Column:
    """The value's replacement, or itself."""
    if not values:
        return column(x)
    table = F.create_map(*[F.lit(y) for pair in values.items() for y in pair])
    return F.coalesce(F.try_element_at(table, column(x)), column(x))


def capitalised_names(x: str | Column) -> Column:
    """Runs of capitalised words without possessives, each once in order, longer than a letter and not in the stop list."""
    found = F.transform(F.regexp_extract_all(column(x), F.lit(NAME_PATTERN), F.lit(0)), lambda n: F.regexp_replace(n, r"'s$", ""))
    return F.array_distinct(F.filter(found, lambda n: (F.length(n) > 1) & ~n.isin(*NOT_NAMES)))


def likely_person(name: str | Column) -> Column:
    n = column(name)
    return F.length(n).between(2, 50) & n.rlike("[A-Za-z]") & ~n.isin(*NOT_PERSONS) & (F.upper(n) != n) & (F.lower(n) != n)


def name_in_content(name: str | Column, content: str | Column) -> Column:
    """Whether the name, or else each of its words, is in the content (the name in any case)."""
    n, c = column(name), column(content)
    return F.contains(F.lower(c), F.lower(n)) | F.forall(F.split(n, r"\s+"), lambda p: F.contains(c, p))


def keyword_question(question: str | Column, allow: list[str], block: list[str], keywords: list[str]) -> Column:
    """True by an allowed phrase, else false by a blocked one, else true by a keyword; phrases in lower case are looked for in lower case."""
    q = F.lower(column(question))
    has = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(q, p)) if phrases else F.lit(False)
    return F.when(has(allow), True).when(has(block), False).otherwise(has(keywords))


def safe_file_name(title: str | Column) -> Column:
    return F.translate(F.replace(column(title), F.lit(" "), F.lit("_")), '/\\:*?"<>|', "_________")


def shortened(x: str | Column, most: int = 89) -> Column:
    t = column(x)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def spreadsheet_safe(x: str | Column) -> Column:
    """A cell that no spreadsheet takes for a formula, on one line, with single quotation marks."""
    t = F.trim(F.translate(F.replace(column(x), F.lit('"'), F.lit("'")), "\r\n\t", "   "))
    return F.when(t.rlike(r"^[=+\-@]"), F.concat(F.lit(" "), t)).otherwise(t)


def dataset_name(path: str | Column) -> Column:
    """What stands before the first underscore of a path's last part."""
    return F.substring_index(F.element_at(F.split(F.rtrim(column(path), F.lit("/")), "/"), -1), "_", 1)


def method_name(directory: str | Column) -> Column:
    d = column(directory)
    return F.when(F.contains(d, F.lit("concat")), "concat").when(F.contains(d, F.lit("iterative")), "iterative")


def option_of(command: str | Column, option: str) -> Column:
    """The number or word after a command-line option; null if it isn't there."""
    return F.nullif(F.regexp_extract(column(command), f"--{option}\\s+(\\S+)", 1), F.lit(""))


def filled(template: str | Column, values: dict[str, str | Column]) -> Column:
    """A template with its ``{names}`` replaced one after the other, so later names are replaced in earlier values too."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.lit(value) if isinstance(value, str) else value)
    return out


def indel_ratio(a: str | Column, b: str | Column) -> Column:
    """Twice the longest common subsequence over both lengths: one row of the table is carried over the characters. For names, not texts."""
    a, b = column(a), column(b)
    right = F.split(b, "")
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def next_row(row: Column, char: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda done, j: F.array_append(done, F.when(F.get(right, j - 1) == char, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.element_at(done, -1)))),
        )

    lcs = F.element_at(F.aggregate(F.split(a, ""), zero, next_row), -1)
    return F.when((F.length(a) == 0) & (F.length(b) == 0), 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(2 * lcs / (F.length(a) + F.length(b)))
