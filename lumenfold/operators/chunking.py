"""Chunking of documents into content-preserving pieces, as column expressions (no Python on the data path).

Fixed-size packing is a fold over the lengths of a text's units.  Its state is the list of chunk starts and the size of the open
chunk, so a unit costs a constant amount of work, and chunks are cut once at the end.
Errors are data: ``error`` names the first rule that a row breaks, and no row fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Last chunks shorter than this are merged or lead to a new division.
MIN_LEN = 400


class ChunkingError(ValueError):
    """Wrong parameters of a chunking operator."""


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + "'"


def units(text: str | Column, delimiter: str = "\n") -> Column:
    """The text between delimiters, empty pieces too."""
    return F.split(text if isinstance(text, Column) else F.col(text), "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


SENTENCE_END = r"(?<=[.!?])[\"')\]]*\s+(?=[A-Z0-9\"'(\[])"


def sentences(text: str | Column) -> Column:
    """Sentences by punctuation, white space and a capital letter or digit: a fixed rule in place of a trained model."""
    return F.split(F.trim(text if isinstance(text, Column) else F.col(text)), SENTENCE_END, -1)


def check_parameters(delimiter: str, **positive: int) -> None:
    for name, value in positive.items():
        if not isinstance(value, int) or isinstance(value, bool):
            raise ChunkingError(f"{name} must be an integer, got {type(value).__name__}")
        if value <= 0:
            raise ChunkingError(f"{name} must be positive, got {value}")
    if not isinstance(delimiter, str):
        raise ChunkingError(f"delimiter must be a string, got {type(delimiter).__name__}")
    if not delimiter:
        raise ChunkingError("delimiter cannot be empty")


def starts(lengths: str, size: str, joiner: int) -> Column:
    """Numbers of the units that start a chunk, greedily: a unit joins the open chunk while it fits, and a chunk has one unit at least."""
    return F.expr(
        f"""aggregate(
            transform({lengths}, (n, i) -> named_struct('n', n, 'i', i)),
            named_struct('starts', cast(array() as array<int>), 'used', 0),
            (a, u) -> if(size(a.starts) > 0 and a.used + {joiner} + u.n <= {size},
                         named_struct('starts', a.starts, 'used', a.used + {joiner} + u.n),
                         named_struct('starts', array_append(a.starts, u.i), 'used', u.n)),
            a -> a.starts)"""
    )


def cut(units_col: str, starts_col: str, joiner: str) -> Column:
    return F.expr(
        f"""transform({starts_col}, (s, k) -> array_join(
            slice({units_col}, s + 1, coalesce(get({starts_col}, k + 1), size({units_col})) - s), {_literal(joiner)}))"""
    )


def _merged_tail(chunks: str, joiner: str) -> str:
    return f"array_append(slice({chunks}, 1, size({chunks}) - 2), concat(element_at({chunks}, -2), {_literal(joiner)}, element_at({chunks}, -1)))"


def errors(text: str, delimiter: str, *, need_delimiter: Column | bool = True) -> Column:
    """The first text-dependent rule that a row breaks: there is a text, it isn't empty, and the delimiter is in it."""
    value = F.col(text)
    lacks = ~F.contains(value, F.lit(delimiter)) & (need_delimiter if isinstance(need_delimiter, Column) else F.lit(need_delimiter))
    return F.when(value.isNull(), "text must be a string").when(value == "", "cannot chunk empty text").when(lacks, "delimiter not found in text")


def _split(df: DataFrame, text: str, delimiter: str, sentence_mode: bool) -> DataFrame:
    return df.withColumn("__u", sentences(text) if sentence_mode else units(text, delimiter)).withColumn("__n", F.transform("__u", F.length))


def fixed_size(df: DataFrame, chunk_size: int, *, delimiter: str = "\n", text: str = "text", rebalance: bool = True, min_len: int = MIN_LEN, sentence_mode: bool = False) -> DataFrame:
    """Adds ``chunks`` of about ``chunk_size`` characters along delimiters, and ``error``.

    With ``rebalance`` a last chunk under ``min_len`` joins the one before; one of up to half the size leads to a new
    division with a larger size, after which a last chunk under 1.5 times ``min_len`` joins the one before.
    """
    check_parameters(delimiter, chunk_size=chunk_size)
    joiner = " " if sentence_mode else delimiter
    j = len(joiner)
    bad = errors(text, delimiter, need_delimiter=not sentence_mode)
    out = _split(df.withColumn("error", bad), text, delimiter, sentence_mode)
    out = out.withColumn("__s", starts("__n", str(chunk_size), j)).withColumn("__c", cut("__u", "__s", joiner))
    if rebalance:
        last, n = "length(element_at(__c, -1))", "size(__c)"
        again = f"{n} > 1 and {last} >= {min_len} and {last} <= {0.5 * chunk_size}"
        larger = f"cast(floor(({chunk_size}L * ({n} - 1) + {last}) / ({n} - 1)) as int)"
        out = out.withColumn("__size", F.expr(f"if({again}, {larger}, null)"))
        out = out.withColumn("__s2", F.when(F.col("__size").isNotNull(), starts("__n", "__size", j))).withColumn("__c2", cut("__u", "__s2", joiner))
        out = out.withColumn(
            "__c",
            F.expr(
                f"""case when {n} > 1 and {last} < {min_len} then {_merged_tail("__c", joiner)}
                    when __c2 is null then __c
                    when size(__c2) > 1 and length(element_at(__c2, -1)) < {1.5 * min_len} then {_merged_tail("__c2", joiner)}
                    else __c2 end"""
            ),
        ).drop("__size", "__s2", "__c2")
    return out.withColumn("chunks", F.when(F.col("error").isNull(), F.col("__c"))).drop("__u", "__n", "__s", "__c")


def fixed_count(df: DataFrame, num_chunks: int, *, delimiter: str = "\n", text: str = "text", sentence_mode: bool = False) -> DataFrame:
    """Adds ``chunks``, ``num_chunks`` of them with the same number of units give or take one (longer ones first), and ``error``.

    One chunk is the whole text, delimiter or not; a text with fewer units has a chunk for each.
    """
    check_parameters(delimiter, num_chunks=num_chunks)
    joiner = " " if sentence_mode else delimiter
    out = df.withColumn("error", errors(text, delimiter, need_delimiter=num_chunks > 1 and not sentence_mode))
    if num_chunks == 1:
        return out.withColumn("chunks", F.when(F.col("error").isNull(), F.array(F.col(text))))
    out = out.withColumn("__u", sentences(text) if sentence_mode else units(text, delimiter))
    q, r = f"(size(__u) div {num_chunks})", f"(size(__u) % {num_chunks})"
    made = f"""transform(sequence(0, {num_chunks - 1}), i -> array_join(slice(__u, cast(1 + i * {q} + least(i, {r}) as int), cast({q} + if(i < {r}, 1, 0) as int)), {_literal(joiner)}))"""
    return out.withColumn("chunks", F.expr(f"case when error is not null then null when size(__u) < {num_chunks} then __u else {made} end")).drop("__u")


STRATEGIES = {"fixed_size": fixed_size, "fixed_count": fixed_count}


def register(name: str, strategy) -> None:
    """Adds a chunking strategy: a function of a DataFrame and a size or count that adds ``chunks`` and ``error``."""
    STRATEGIES[name] = strategy


def chunk(df: DataFrame, strategy: str, amount: int, **options) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ChunkingError(f"unknown strategy {strategy!r}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](df, amount, **options)


def split_errors(chunked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with chunks, and rows with an error."""
    return chunked.where("error is null").drop("error"), chunked.where("error is not null").drop("chunks")


def preserved(text: str, chunks: str, joiner: str = "\n", *, normalize_whitespace: bool = False) -> Column:
    """Whether the chunks put together are the text, up to white space if asked for."""
    whole, own = F.array_join(chunks, joiner), F.col(text)
    if normalize_whitespace:
        whole, own = (F.regexp_replace(x, r"(?U)\s+", "") for x in (whole, own))
    return whole == own


def statistics(chunks: str = "chunks") -> Column:
    """Number of chunks, characters, and the mean, least, largest and population deviation of their lengths."""
    return F.expr(
        f"""transform(array(transform({chunks}, c -> cast(length(c) as bigint))), n -> named_struct(
            'num_chunks', cast(size(n) as bigint),
            'total_chars', aggregate(n, 0L, (a, x) -> a + x),
            'avg_chunk_size', aggregate(n, 0L, (a, x) -> a + x) / size(n),
            'min_chunk_size', array_min(n),
            'max_chunk_size', array_max(n),
            'size_std', sqrt(greatest(0.0, aggregate(n, 0L, (a, x) -> a + x * x) / size(n) - pow(aggregate(n, 0L, (a, x) -> a + x) / size(n), 2)))))[0]"""
    )


def with_reveal(chunked: DataFrame, reveal: str | Column, chunks: str = "chunks") -> DataFrame:
    """Statistics of the chunks, then the reveal text as one more chunk; without a reveal the chunks stay as they are."""
    told = F.nullif(reveal if isinstance(reveal, Column) else F.col(reveal), F.lit(""))
    return chunked.withColumn("stats", statistics(chunks)).withColumn(chunks, F.when(told.isNotNull(), F.array_append(chunks, told)).otherwise(F.col(chunks))).withColumn("reveal_added", told.isNotNull())


def long_form(chunked: DataFrame, *keys: str, chunks: str = "chunks") -> DataFrame:
    return chunked.select(*keys, F.posexplode(chunks).alias("chunk_index", "chunk"))


def previews(chunks: str = "chunks", width: int = 100) -> Column:
    """A line for each chunk: its number and its start, with line feeds and tabs spelled out."""
    return F.transform(chunks, lambda c, i: F.concat(F.lit("Chunk "), (i + 1).cast("string"), F.lit(": "), F.replace(F.replace(F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))))


def item_statistics(documents: DataFrame, item: str) -> DataFrame:
    """Of an item's documents (with ``stats``): chunks in all, and their mean size from the documents' rounded means."""
    n, mean = F.col("stats.num_chunks"), F.round("stats.avg_chunk_size", 1)
    return documents.groupBy(item).agg(F.sum(n).alias("total_chunks"), F.round(F.sum(mean * n) / F.sum(n), 1).alias("avg_chunk_size"), F.sum("stats.total_chars").alias("total_chars"))


def collection_statistics(documents: DataFrame) -> DataFrame:
    n = F.sum("stats.num_chunks")
    return documents.agg(F.count("*").alias("documents"), n.alias("chunks"), F.sum("stats.total_chars").alias("total_chars"), F.min("stats.min_chunk_size").alias("min_chunk_size"), F.max("stats.max_chunk_size").alias("max_chunk_size"), (F.sum("stats.total_chars") / n).alias("avg_chunk_size"))
