"""Chat formatting: records of many layouts become canonical turns, and those a marked and masked text.

A record's schema fingerprint is a hash of the nested paths of the fields that it fills.  It selects a declarative mapping that says
where the turns are.  Everything is column expressions.

The template is ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` for each turn.  In texts, ``<|`` gets a backslash between its characters, and a ``<`` with
backslashes before a ``|`` one more, so no text holds a mark and every text can be had back.  Roles are URL-encoded.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Layout:
    """Field paths that a record of this layout fills, the SQL expression of its turns (an array of role and text), and paths (with all below them) that it may fill besides."""

    name: str
    paths: tuple[str, ...]
    turns: str
    optional: tuple[str, ...] = ()


def _listed(column: str, role: str, text: str, aliases: dict[str, str]) -> str:
    said = f"coalesce(m.{role}, '')"
    if aliases:
        said = f"CASE m.{role} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in aliases.items()) + f" ELSE {said} END"
    return f"transform({column}, m -> named_struct('role', {said}, 'text', coalesce(m.{text}, '')))"


def _pair(question: str, answer: str) -> str:
    return f"array(named_struct('role', 'user', 'text', coalesce({question}, '')), named_struct('role', 'assistant', 'text', coalesce({answer}, '')))"


#: Fields about a record, not of its conversation: they are outside its fingerprint.
METADATA = ("id", "uid", "uuid", "tags", "source", "dataset", "lang", "language", "category", "score", "model", "created", "timestamp", "meta", "metadata")
_PARTS = "transform(messages, m -> named_struct('role', coalesce(m.role, ''), 'text', array_join(transform(filter(coalesce(m.content, array()), p -> p.text IS NOT NULL), p -> p.text), '')))"
_SAID = {"human": "user", "gpt": "assistant", "bot": "assistant"}
_ASKED = "concat(coalesce(instruction, ''), '\\n\\n', coalesce(input, ''))"
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), _listed("messages", "role", "content", {}), ("messages[].name", "messages[].weight")),
    Layout("message_parts", ("messages[].role", "messages[].content[].type", "messages[].content[].text"), _PARTS, ("messages[].name", "messages[].weight", "messages[].content[]")),
    Layout("shared", ("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value", _SAID)),
    Layout("completion", ("prompt", "completion"), _pair("prompt", "completion")),
    Layout("response", ("prompt", "response"), _pair("prompt", "response")),
    Layout("instruction", ("instruction", "output"), _pair("instruction", "output")),
    Layout("instruction_input", ("instruction", "input", "output"), _pair(_ASKED, "output")),
    Layout("prompt_only", ("prompt",), "array(named_struct('role', 'user', 'text', prompt))"),
    Layout("text_only", ("text",), "array(named_struct('role', 'assistant', 'text', text))"),
)


def _filled(kind: T.DataType, name: str, some) -> list[tuple[str, Column]]:
    """Nested paths of a field, at any depth, and whether a record fills them; ``some`` makes a condition on a value one on the record."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _filled(f.dataType, f"{name}.{f.name}", lambda test, f=f: some(lambda v: test(v[f.name])))]
    if isinstance(kind, T.ArrayType):
        each = lambda test: some(lambda v: F.coalesce(F.exists(v, test), F.lit(False)))
        if isinstance(kind.elementType, T.StructType | T.ArrayType):
            return _filled(kind.elementType, f"{name}[]", each)
        return [(f"{name}[]", some(lambda v: F.coalesce(F.size(v) > 0, F.lit(False))))]
    return [(name, some(lambda v: v.isNotNull()))]


def path_hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def fingerprint(records: DataFrame, fields: list[str], optional: tuple[str, ...] = ()) -> Column:
    """Hash of the sorted paths of the fields (with nested ones) that a record fills, without the ``optional`` ones and what is below them."""
    paths = [x for f in fields for x in _filled(records.schema[f].dataType, f, lambda test, f=f: test(F.col(f"`{f}`")))]
    kept = [(path, on) for path, on in paths if not any(path == o or path.startswith((f"{o}.", f"{o}[")) for o in optional)]
    return path_hash(F.array_compact(F.array(*[F.when(on, F.lit(path)) for path, on in kept])) if kept else F.array().cast("array<string>"))


def _turns_of(records: DataFrame, layout: Layout) -> Column | None:
    """The turns' expression; None if the records lack its fields or have them in types that it isn't for."""
    made = F.expr(layout.turns).cast(f"array<{TURN}>")
    try:
        records.select(made).schema  # noqa: B018  analysed, not run
    except AnalysisException:
        return None
    return made


def canonical(records: DataFrame, *, id_cols: list[str], layouts: tuple[Layout, ...] = LAYOUTS, metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """``id_cols, layout, turns``: the layout that each record's fingerprint selects and its canonical turns.

    All other columns are the records' fields but for those named in ``metadata``.  A role or text that is null counts as unfilled and is empty in the turns; a list layout is
    also selected by records that fill only some of its paths in the list.  Of contents that are lists of parts the texts are joined, parts without a text give none.  A record that no mapping
    knows, and one whose fields have types that no mapping is for, has a null layout and no turns.
    """
    fields = [c for c in records.columns if c not in id_cols and c not in metadata]
    layout, turns = F.lit(None).cast("string"), F.array().cast(f"array<{TURN}>")
    prints = {}  # a fingerprint for each set of optional paths
    for x in reversed(layouts):
        made = _turns_of(records.select(*[F.col(f"`{c}`") for c in fields]), x)
        if made is None:
            continue
        name = prints.setdefault(x.optional, f"__fp{len(prints)}")
        inner = [p for p in x.paths if p not in x.optional and not any(p.startswith((f"{o}.", f"{o}[")) for o in x.optional)]
        nested = all("[]." in p for p in x.paths)
        subsets = [inner] if not nested else [[p for k, p in enumerate(inner) if m >> k & 1] for m in range(1, 1 << len(inner))]
        is_it = functools.reduce(lambda a, b: a | b, [F.col(name) == path_hash(F.array(*map(F.lit, s))) for s in subsets])
        layout, turns = F.when(is_it, F.lit(x.name)).otherwise(layout), F.when(is_it, made).otherwise(turns)
    seen = records.withColumns({name: fingerprint(records, fields, optional) for optional, name in prints.items()}) if prints else records
    return seen.select(*id_cols, layout.alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def formatted(turns_df: DataFrame, *, turns_col: str = "turns", learn: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``: for each turn of the text whether the loss covers what stands between its role's line and its end mark.

    Null or no turns give an empty text and mask.
    """
    turns = F.coalesce(F.col(turns_col), F.array().cast(f"array<{TURN}>"))
    said = F.transform(turns, lambda t: F.concat(F.lit(START), F.url_encode(F.coalesce(t["role"], F.lit(""))), F.lit("\n"), escaped(F.coalesce(t["text"], F.lit(""))), F.lit(END + "\n")))
    mask = F.transform(turns, lambda t: F.coalesce(t["role"] == learn, F.lit(False)))
    return turns_df.withColumn("formatted", F.array_join(said, "")).withColumn("loss_mask", mask)


def read_back(text: str | Column, mask: str | Column) -> Column:
    """The turns of a formatted text: an array of role, text and whether the loss covers the text."""
    text, mask = (F.col(x) if isinstance(x, str) else x for x in (text, mask))
    pieces = F.split(text, r"\Q" + START + r"\E", -1)
    parts = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.zip_with(
        parts,
        mask,
        lambda part, on: F.struct(
            F.url_decode(F.substring_index(part, "\n", 1)).alias("role"),
            unescaped(F.regexp_replace(F.regexp_replace(part, r"(?s)\A[^\n]*\n", ""), r"\Q" + END + r"\E\n\z", "")).alias("text"),
            on.alias("loss"),
        ),
    )


def gathered(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as records: a conversation is one row, in the layout that fits it.

    ``prompt`` and ``completion`` if it is a question and its answer; else ``conversations`` if its roles are user and assistant; else ``messages``.
    Turns are in order of their number, ties by role and text, repeated rows all kept; null roles and texts are empty and null ids are one conversation.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(id_col).alias(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    pair = F.coalesce(roles == F.array(F.lit("user"), F.lit("assistant")), F.lit(False))
    plain = F.forall(roles, lambda x: x.isin("user", "assistant"))
    shared = F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise("gpt").alias("from"), x["text"].alias("value")))
    listed = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return grouped.select(
        id_col,
        F.when(pair, F.col("t")[0]["text"]).alias("prompt"),
        F.when(pair, F.col("t")[1]["text"]).alias("completion"),
        F.when(plain & ~pair, shared).alias("conversations"),
        F.when(~plain, listed).alias("messages"),
    )
