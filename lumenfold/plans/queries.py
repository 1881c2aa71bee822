"""The registered queries of the engine's own operators and their DuckDB twins.

The driver's tables stand in for collections: ``documents`` are items (a source is a collection), ``conversations`` are ordered
steps of an item, ``labels`` are assessments, ``benchmark`` has reference texts and ``events`` is a spending log.
Ratios are compared as whole millionths, so no engine's summation order shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranges, stats, text
from ..operators import analysis, assessment, chunking, claims, containment, entities, overlap, summarize


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ppm(x: Column | str) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) * 1e6 + 0.5).cast("long")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as items with an array of texts in order."""
    rows = _table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).select("conv_id", F.transform("t", lambda x: x["text"]).alias("steps"))


# ---- chunking

_PACK = """
WITH RECURSIVE d AS (SELECT doc_id, lang, string_split(text, chr(10)) AS u FROM documents WHERE contains(text, chr(10))),
p AS (
  SELECT doc_id, lang, u, 1 AS i, 1 AS c, CAST(length(u[1]) AS BIGINT) AS used FROM d
  UNION ALL
  SELECT doc_id, lang, u, i + 1,
         CASE WHEN used + 1 + length(u[i + 1]) <= 1000 THEN c ELSE c + 1 END,
         CASE WHEN used + 1 + length(u[i + 1]) <= 1000 THEN used + 1 + length(u[i + 1]) ELSE length(u[i + 1]) END
  FROM p WHERE i < len(u)
),
chunk AS (SELECT doc_id, lang, c, max_by(used, i) AS n FROM p GROUP BY doc_id, lang, c)
"""


@query(
    _PACK
    + """SELECT lang, CAST(count(*) AS BIGINT) AS chunks, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS total_chars,
 CAST(min(n) AS BIGINT) AS min_chunk_size, CAST(max(n) AS BIGINT) AS max_chunk_size, CAST(floor(sum(n) / count(*) * 1e6 + 0.5) AS BIGINT) AS avg_chunk_size_ppm FROM chunk GROUP BY lang"""
)
def chunk_fixed_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = chunking.split_errors(chunking.fixed_size(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), 1000, rebalance=False))
    one = made.withColumn("stats", chunking.statistics())
    total, n = F.sum("stats.total_chars"), F.sum("stats.num_chunks")
    return one.groupBy("lang").agg(n.alias("chunks"), F.count("*").alias("documents"), total.alias("total_chars"), F.min("stats.min_chunk_size").alias("min_chunk_size"), F.max("stats.max_chunk_size").alias("max_chunk_size"), _ppm(total / n).alias("avg_chunk_size_ppm"))


def _rebalanced_sql(size: int, least: int) -> str:
    step = """SELECT doc_id, u, size, i + 1, CASE WHEN used + 1 + length(u[i + 1]) <= size THEN c ELSE c + 1 END,
         CASE WHEN used + 1 + length(u[i + 1]) <= size THEN used + 1 + length(u[i + 1]) ELSE length(u[i + 1]) END FROM {0} WHERE i < len(u)"""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS u FROM documents WHERE contains(text, chr(10))),
p AS (SELECT doc_id, u, CAST({size} AS BIGINT) AS size, 1 AS i, 1 AS c, CAST(length(u[1]) AS BIGINT) AS used FROM d UNION ALL {step.format("p")}),
c1 AS (SELECT doc_id, any_value(u) AS u, c, max_by(used, i) AS n FROM p GROUP BY doc_id, c),
s1 AS (SELECT doc_id, any_value(u) AS u, count(*) AS k, max_by(n, c) AS last FROM c1 GROUP BY doc_id),
again AS (SELECT doc_id, u, CAST(floor(({size} * (k - 1) + last) / (k - 1)) AS BIGINT) AS size FROM s1 WHERE k > 1 AND last >= {least} AND last <= {size} * 0.5),
p2 AS (SELECT doc_id, u, size, 1 AS i, 1 AS c, CAST(length(u[1]) AS BIGINT) AS used FROM again UNION ALL {step.format("p2")}),
c2 AS (SELECT doc_id, c, max_by(used, i) AS n FROM p2 GROUP BY doc_id, c),
s2 AS (SELECT doc_id, count(*) AS k, max_by(n, c) AS last FROM c2 GROUP BY doc_id)
SELECT CAST(s1.doc_id AS BIGINT) AS doc_id,
  CAST(CASE WHEN s2.k IS NOT NULL THEN s2.k - CASE WHEN s2.k > 1 AND s2.last < {least} * 1.5 THEN 1 ELSE 0 END
            ELSE s1.k - CASE WHEN s1.k > 1 AND s1.last < {least} THEN 1 ELSE 0 END END AS BIGINT) AS num_chunks,
  CASE WHEN s2.k IS NOT NULL THEN 'again' WHEN s1.k > 1 AND s1.last < {least} THEN 'merged' ELSE 'kept' END AS how
FROM s1 LEFT JOIN s2 USING (doc_id)"""


@query(_rebalanced_sql(2000, 400))
def chunk_fixed_size_rebalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made, _ = chunking.split_errors(chunking.fixed_size(docs, 2000))
    plain, _ = chunking.split_errors(chunking.fixed_size(made.drop("chunks"), 2000, rebalance=False))
    last, n = F.length(F.element_at("plain", -1)), F.size("plain")
    how = F.when((n > 1) & (last < 400), "merged").when((n > 1) & last.between(400, 1000), "again").otherwise("kept")
    both = made.select("doc_id", "chunks").join(plain.select("doc_id", F.col("chunks").alias("plain")), "doc_id")
    return both.select("doc_id", F.size("chunks").cast("long").alias("num_chunks"), how.alias("how"))


@query(
    """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS u FROM documents WHERE contains(text, chr(10))),
q AS (SELECT *, len(u) // 5 AS q, len(u) % 5 AS r FROM d),
c AS (SELECT doc_id, CASE WHEN len(u) < 5 THEN u ELSE [array_to_string(u[1 + i * q + least(i, r) : (i + 1) * q + least(i + 1, r)], chr(10)) FOR i IN range(5)] END AS c FROM q)
SELECT doc_id, CAST(len(c) AS BIGINT) AS num_chunks, CAST(length(c[1]) AS BIGINT) AS first_chars, CAST(length(c[len(c)]) AS BIGINT) AS last_chars, md5(array_to_string(c, '|')) AS digest FROM c"""
)
def chunk_fixed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = chunking.split_errors(chunking.fixed_count(_table(spark, sf_dir, "documents").select("doc_id", "text"), 5))
    size = lambda k: F.length(F.element_at("chunks", k)).cast("long")
    return made.select("doc_id", F.size("chunks").cast("long").alias("num_chunks"), size(1).alias("first_chars"), size(-1).alias("last_chars"), F.md5(F.array_join("chunks", "|").cast("binary")).alias("digest"))


@query("SELECT lang, CASE WHEN contains(text, chr(10)) THEN 'ok' ELSE 'delimiter not found in text' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1, 2")
def chunk_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.fixed_size(_table(spark, sf_dir, "documents").select("lang", "text"), 1000)
    return made.groupBy("lang", F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS preserved FROM documents WHERE contains(text, chr(10)) GROUP BY lang")
def chunk_content_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = chunking.split_errors(chunking.fixed_size(_table(spark, sf_dir, "documents").select("lang", "text"), 1500))
    return made.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(chunking.preserved("text", "chunks")).alias("preserved"))


@query(
    """WITH b AS (SELECT min(text) AS reveal FROM benchmark), d AS (SELECT doc_id, string_split(text, chr(10)) AS u FROM documents WHERE contains(text, chr(10))),
q AS (SELECT *, len(u) // 3 AS q, len(u) % 3 AS r FROM d),
c AS (SELECT doc_id, CASE WHEN len(u) < 3 THEN u ELSE [array_to_string(u[1 + i * q + least(i, r) : (i + 1) * q + least(i + 1, r)], chr(10)) FOR i IN range(3)] END AS c FROM q)
SELECT doc_id, CAST(len(c) AS BIGINT) AS counted_chunks, CAST(len(c) + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS chunks,
 CAST(list_sum([length(x) FOR x IN c]) AS BIGINT) AS counted_chars, CAST(CASE WHEN doc_id % 2 = 0 THEN length(b.reveal) ELSE length(c[len(c)]) END AS BIGINT) AS last_chars FROM c, b"""
)
def chunk_reveal_addon(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _table(spark, sf_dir, "benchmark").agg(F.min("text").alias("told"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").crossJoin(F.broadcast(told)).withColumn("reveal", F.when(F.col("doc_id") % 2 == 0, F.col("told")))
    made, _ = chunking.split_errors(chunking.fixed_count(docs, 3))
    out = chunking.with_reveal(made, "reveal")
    return out.select("doc_id", F.col("stats.num_chunks").alias("counted_chunks"), F.size("chunks").cast("long").alias("chunks"), F.col("stats.total_chars").alias("counted_chars"), F.length(F.element_at("chunks", -1)).cast("long").alias("last_chars"))


@query(
    """SELECT source, CAST(count(*) AS BIGINT) AS texts, CAST(min(length(text)) AS BIGINT) AS min_chars, CAST(max(length(text)) AS BIGINT) AS max_chars, CAST(sum(length(text)) // count(*) AS BIGINT) AS avg_chars,
 CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(count(*) FILTER (length(text) = 0) AS BIGINT) AS empty, CAST(count(*) FILTER (length(text) < 1000) AS BIGINT) AS under_1k, CAST(count(*) FILTER (length(text) > 1000000) AS BIGINT) AS over_1m FROM documents GROUP BY source"""
)
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.corpus_summary(_table(spark, sf_dir, "documents"), "text", "source")
    return out.select(*[F.col(c).cast("long").alias(c) if c != "source" else c for c in out.columns])


@query(
    """WITH d AS (SELECT doc_id, lang, string_split(text, chr(10)) AS u FROM documents WHERE contains(text, chr(10))),
w AS (SELECT lang, len([y FOR y IN regexp_split_to_array(x, '\\s+') IF y <> '']) AS n FROM (SELECT lang, unnest(u) AS x FROM d))
SELECT lang, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(n) AS BIGINT) AS words, CAST(max(n) AS BIGINT) AS most FROM w GROUP BY lang"""
)
def words_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where(F.contains("text", F.lit("\n"))).select("doc_id", "lang", chunking.units("text").alias("chunks"))
    each = chunking.long_form(docs, "lang").withColumn("n", text.word_count("chunk").cast("long"))
    return each.groupBy("lang").agg(F.count("*").alias("chunks"), F.sum("n").alias("words"), F.max("n").alias("most"))


# ---- ranges

_LIST = "WITH c AS (SELECT conv_id, list(text ORDER BY turn, role, text) AS s FROM conversations GROUP BY conv_id), l AS (SELECT *, len(s) AS n FROM c) "


def _range_sql(selections: dict[str, tuple[str, str]], joiner: str) -> str:
    """Of each specification: its positions (an array expression) and the condition under which it fits."""
    parts = [f"SELECT conv_id, '{spec}' AS spec, CASE WHEN {ok} THEN md5(array_to_string([s[i] FOR i IN {at}], {joiner})) END AS digest, CASE WHEN {ok} THEN CAST(len({at}) AS BIGINT) END AS picked FROM l" for spec, (at, ok) in selections.items()]
    return _LIST + " UNION ALL ".join(parts)


def _ranges(spark: SparkSession, sf_dir: str, dialect: str, specs: list[str]) -> DataFrame:
    steps = _steps(spark, sf_dir)
    picked = F.explode(F.array(*[F.struct(F.lit(s).alias("spec"), ranges.select_range("steps", s, dialect).alias("r")) for s in specs])).alias("x")
    return steps.select("conv_id", picked).select("conv_id", "x.spec", F.md5(F.col("x.r.text").cast("binary")).alias("digest"), F.size("x.r.positions").cast("long").alias("n")).select("conv_id", "spec", "digest", F.when(F.col("digest").isNotNull(), F.col("n")).alias("picked"))


@query(_range_sql({"all": ("range(1, n + 1)", "n > 0"), "last": ("[n]", "n > 0"), "penultimate": ("[n - 1]", "n >= 2"), "all-but-last": ("range(1, n)", "n >= 2"), "3": ("[3]", "n >= 3"), "2-4": ("range(2, 5)", "n >= 4"), "4-2": ("[1]", "false")}, "chr(10)"))
def range_select_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir, ranges.STRICT, ["all", "last", "penultimate", "all-but-last", "3", "2-4", "4-2"])


@query(_range_sql({"all": ("range(1, n + 1)", "n > 0"), "penultimate": ("[greatest(n - 1, 1)]", "n > 0"), "all-but-last": ("CASE WHEN n > 1 THEN range(1, n) ELSE [1] END", "n > 0"), "3": ("[3]", "n >= 3"), "2-4": ("range(2, least(n, 4) + 1)", "n >= 2"), "1-99": ("range(1, n + 1)", "n > 0")}, "chr(10) || chr(10)"))
def range_select_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir, ranges.CLAMPED, ["all", "penultimate", "all-but-last", "3", "2-4", "1-99"])


@query(_range_sql({"all": ("[n]", "n > 0"), "penultimate": ("[greatest(n - 1, 1)]", "n > 0"), "all-but-last": ("[greatest(n - 1, 1)]", "n > 0"), "3": ("[3]", "n >= 3"), "2-4": ("[4]", "n >= 4")}, "chr(10)"))
def range_select_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir, ranges.SINGLE, ["all", "penultimate", "all-but-last", "3", "2-4"])


@query(_LIST + ", r AS (SELECT conv_id, unnest(range(1, least(n, 5) + 1)) AS range_num FROM l) SELECT conv_id, CAST(range_num AS BIGINT) AS range_num, CAST(length(s[range_num]) AS BIGINT) AS chars FROM r JOIN l USING (conv_id)")
def multi_range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _steps(spark, sf_dir).withColumn("range_num", F.explode(ranges.expanded("steps", 5)))
    return each.select("conv_id", F.col("range_num").cast("long").alias("range_num"), F.length(F.element_at("steps", F.col("range_num"))).cast("long").alias("chars"))


# ---- summaries

@query("SELECT conv_id, turn, md5(string_agg(text, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS digest FROM conversations")
def prefix_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = summarize.prefixes_long(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return made.select("conv_id", "turn", F.md5(F.col("prefix").cast("binary")).alias("digest"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS chunks, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id")
def noop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("conv_id", F.size("steps").cast("long").alias("chunks"), F.md5(summarize.no_op("steps").cast("binary")).alias("digest"))


@query(
    _LIST.replace("WITH c", "WITH RECURSIVE c")
    + """, f AS (SELECT conv_id, s, n, 1 AS k, substr(substr(s[1], 1, 40) || ' ', 1, 80) AS summary FROM l
UNION ALL SELECT conv_id, s, n, k + 1, substr(substr(s[k + 1], 1, 40) || ' ' || summary, 1, 80) FROM f WHERE k < n)
SELECT conv_id, CAST(k AS BIGINT) AS summary_index, summary FROM f"""
)
def iterative_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _steps(spark, sf_dir).select("conv_id", F.posexplode(summarize.lead_fold("steps")).alias("i", "summary"))
    return made.select("conv_id", (F.col("i") + 1).cast("long").alias("summary_index"), "summary")


@query(ORACLES["iterative_fold"])
def iterative_fold_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same summaries by the fold that calls a function step by step."""
    step = lambda before, chunk: f"{chunk[:40]} {before or ''}"[:80]
    made = summarize.fold(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", step)
    return made.withColumn("summary_index", F.col("summary_index").cast("long"))


@query()
def independent_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize.independent(_steps(spark, sf_dir), "conv_id", "steps")


# ---- overlap

_WORDS = "[w FOR w IN string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' ') IF w <> '']"


def _grams_sql(n: int, sides: str, keys: str) -> str:
    """``sides`` gives keys, side (0 target, 1 prediction) and text."""
    words = _WORDS.format("text")
    k = ", ".join(f"{x}" for x in keys.split(","))
    return f"""sides AS ({sides}), tok AS (SELECT {k}, side, {words} AS w FROM sides),
grams AS (SELECT {k}, side, unnest([array_to_string(w[i : i + {n - 1}], ' ') FOR i IN range(1, len(w) - {n - 1} + 1)]) AS g FROM tok WHERE len(w) >= {n}),
counts AS (SELECT {k}, g, count(*) FILTER (side = 0) AS t, count(*) FILTER (side = 1) AS p FROM grams GROUP BY {k}, g),
sums AS (SELECT {k}, sum(least(t, p)) AS o, sum(t) AS nt, sum(p) AS np FROM counts GROUP BY {k})"""


_SCORED = "CAST(coalesce(o, 0) AS BIGINT) AS overlap, CAST(coalesce(nt, 0) AS BIGINT) AS n_target, CAST(coalesce(np, 0) AS BIGINT) AS n_prediction, CAST(floor(CASE WHEN o > 0 THEN 2 * (o / np) * (o / nt) / (o / np + o / nt) ELSE 0 END * 1e6 + 0.5) AS BIGINT) AS f1_ppm"


def _scored(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "overlap", "n_target", "n_prediction", _ppm("score.f1").alias("f1_ppm"))


_PAIRS = "SELECT doc_id, 0 AS side, text FROM documents UNION ALL SELECT doc_id, 1, b.text FROM documents d, benchmark b WHERE b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)"


def _rouge(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark")
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("target"), (F.col("doc_id") % items.count()).alias("item_id"))
    pairs = docs.join(items.select("item_id", F.col("text").alias("prediction")), "item_id")
    return _scored(overlap.rouge_n(pairs, n, keys=["doc_id"]), "doc_id")


@query(f"WITH {_grams_sql(1, _PAIRS, 'doc_id')} SELECT d.doc_id, {_SCORED} FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark) LEFT JOIN sums USING (doc_id)")
def rouge1_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rouge(spark, sf_dir, 1)


@query(f"WITH {_grams_sql(2, _PAIRS, 'doc_id')} SELECT d.doc_id, {_SCORED} FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark) LEFT JOIN sums USING (doc_id)")
def rouge2_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rouge(spark, sf_dir, 2)


_LAG = "lagged AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS target, text AS prediction FROM conversations), pairs AS (SELECT * FROM lagged WHERE target IS NOT NULL), "


@query(
    "WITH " + _LAG + _grams_sql(2, "SELECT conv_id, turn, 0 AS side, target AS text FROM pairs UNION ALL SELECT conv_id, turn, 1, prediction FROM pairs", "conv_id,turn")
    + f", s AS (SELECT p.conv_id, p.turn, {_SCORED} FROM pairs p LEFT JOIN sums USING (conv_id, turn)) SELECT conv_id, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(overlap) AS BIGINT) AS overlap, CAST(sum(f1_ppm) AS BIGINT) AS f1_ppm FROM s GROUP BY conv_id"
)
def continuity_rouge2(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = overlap.adjacent(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    scored = _scored(overlap.rouge_n(steps, 2, keys=["conv_id", "turn"]), "conv_id", "turn")
    return scored.groupBy("conv_id").agg(F.count("*").alias("pairs"), F.sum("overlap").alias("overlap"), F.sum("f1_ppm").alias("f1_ppm"))


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = overlap.adjacent(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return steps.select("conv_id", "turn", overlap.rouge_l(overlap.tokens("target"), overlap.tokens("prediction")).alias("s")).select("conv_id", "turn", *[_ppm(f"s.{m}").alias(m) for m in ("precision", "recall", "f1")])


# ---- statistics

@query("WITH r AS (SELECT lang, length(text) AS n FROM documents) SELECT lang, CAST(list_sort(list(n))[len(list(n)) // 2 + 1] AS BIGINT) AS upper_median FROM r GROUP BY lang")
def upper_median_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("lang", F.length("text").cast("long").alias("n"))
    return stats.upper_median(rows, ["lang"], "n")


@query("WITH p AS (SELECT role, turn, length(text) AS n FROM conversations) SELECT role, turn, CAST(count(*) AS BIGINT) AS n, CAST(floor(avg(n) * 1e6 + 0.5) AS BIGINT) AS mean_ppm, CAST(floor(stddev_pop(n) / sqrt(count(*)) * 1e3 + 0.5) AS BIGINT) AS sem_milli FROM p GROUP BY role, turn")
def sem_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("role", "turn", F.length("text").alias("n_chars"))
    out = analysis.by_position(rows, "turn", "n_chars", "role")
    return out.select("role", "turn", "n", _ppm("mean").alias("mean_ppm"), F.floor(F.col("sem") * 1e3 + 0.5).cast("long").alias("sem_milli"))


@query("WITH d AS (SELECT conv_id, row_number() OVER w - 1 AS p, length(text) - lag(length(text)) OVER w AS diff FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT CAST(p AS BIGINT) AS diff_position, CAST(count(*) AS BIGINT) AS n, CAST(sum(diff) AS BIGINT) AS total FROM d WHERE diff IS NOT NULL AND p <= 4 GROUP BY p")
def consecutive_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    d = analysis.differences(rows, "conv_id", "turn", "n", most=4)
    return d.groupBy(F.col("diff_position").cast("long").alias("diff_position")).agg(F.count("*").alias("n"), F.sum("diff").alias("total"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS points, CAST(arg_min(length(text), turn) AS BIGINT) AS first, CAST(arg_max(length(text), turn) AS BIGINT) AS last FROM conversations GROUP BY conv_id HAVING count(*) >= 2")
def first_last_dumbbell(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return analysis.first_and_last(rows, "conv_id", "turn", "n")


_BUCKET = "CASE WHEN n <= 0 THEN NULL WHEN n <= 2500 THEN '0-2500' WHEN n <= 5000 THEN '2500-5000' WHEN n <= 10000 THEN '5000-10000' WHEN n > 10000 THEN '10000+' END"


@query(f"WITH j AS (SELECT length(text) AS n, quality FROM documents JOIN labels USING (doc_id)) SELECT {_BUCKET} AS bucket, CAST(count(*) AS BIGINT) AS items, CAST(floor(sum(quality) / count(*) * 1e6 + 0.5) AS BIGINT) AS quality_ppm FROM j GROUP BY 1")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("bucket", stats.length_bucket(F.length("text")))
    return rows.groupBy("bucket").agg(F.count("*").alias("items"), _ppm(F.sum("quality") / F.count("*")).alias("quality_ppm"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(floor(avg(quality) * 1e6 + 0.5) AS BIGINT) AS culprit_ppm, CAST(floor(avg(1 - toxic) * 1e6 + 0.5) AS BIGINT) AS accomplice_ppm, CAST(floor(avg(quality * (1 - toxic)) * 1e6 + 0.5) AS BIGINT) AS both_ppm FROM documents JOIN labels USING (doc_id) GROUP BY source")
def accuracy_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    rows = _labelled(spark, sf_dir).select("source", yes(F.col("quality") == 1).alias("culprit"), yes(F.col("toxic") == 0).alias("accomplice"))
    out = assessment.accuracy(rows, "source")
    return out.select("source", "n", *[_ppm(f"{x}_accuracy").alias(f"{x}_ppm") for x in ("culprit", "accomplice", "both")])


@query("WITH r AS (SELECT lang, source, count(*) AS n, avg(quality) AS acc FROM documents JOIN labels USING (doc_id) GROUP BY lang, source) SELECT lang, CAST(sum(n) AS BIGINT) AS n, CAST(floor(sum(acc * n) / sum(n) * 1e6 + 0.5) AS BIGINT) AS accuracy_ppm FROM r GROUP BY lang")
def weighted_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _labelled(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"), F.avg("quality").alias("acc"))
    return runs.groupBy("lang").agg(F.sum("n").alias("n"), _ppm(stats.weighted_mean("acc", "n")).alias("accuracy_ppm"))


@query("WITH u AS (SELECT user_id, count(*) AS m, CAST(rtrim(round(100.0 * count(*) FILTER (event_type = 'click') / count(*), 1)::VARCHAR || '%', '%') AS DOUBLE) / 100 AS p FROM events GROUP BY user_id) SELECT CAST(count(*) AS BIGINT) AS n, CAST(floor(avg(p) * 1e6 + 0.5) AS BIGINT) AS mean_ppm, CAST(floor(sqrt(sum(p * (1 - p) / m)) / count(*) * 1e6 + 0.5) AS BIGINT) AS se_ppm FROM u")
def human_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("m"), F.concat(F.round(100.0 * F.count_if(F.col("event_type") == "click") / F.count("*"), 1).cast("string"), F.lit("%")).alias("solved"))
    mean, se = stats.human_estimate(stats.percent("solved"), "m")
    return users.agg(F.count("*").alias("n"), _ppm(mean).alias("mean_ppm"), _ppm(se).alias("se_ppm"))


@query("WITH g AS (SELECT source, count(*) AS n, avg(toxic) AS p FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT source, CAST(n AS BIGINT) AS n, CAST(floor(CASE WHEN n > 1 THEN sqrt(p * (1 - p) / n) ELSE 0 END * 1e6 + 0.5) AS BIGINT) AS se_ppm FROM g")
def binomial_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _labelled(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.avg("toxic").alias("p"))
    return g.select("source", "n", _ppm(stats.binomial_se("p", "n")).alias("se_ppm"))


@query("SELECT lang, CAST(floor(quantile_cont(n_chars, 0.25) * 1e3 + 0.5) AS BIGINT) AS q1, CAST(floor(quantile_cont(n_chars, 0.5) * 1e3 + 0.5) AS BIGINT) AS median, CAST(floor(quantile_cont(n_chars, 0.75) * 1e3 + 0.5) AS BIGINT) AS q3, CAST(min(n_chars) AS BIGINT) AS min, CAST(max(n_chars) AS BIGINT) AS max FROM documents GROUP BY lang")
def distribution_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _table(spark, sf_dir, "documents").groupBy("lang").agg(*stats.distribution("n_chars"))
    return out.select("lang", *[F.floor(F.col(c) * 1e3 + 0.5).cast("long").alias(c) for c in ("q1", "median", "q3")], "min", "max")


@query("WITH e AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents) SELECT CAST(least(floor((n_chars - lo) * 20 / (hi - lo)), 19) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM documents, e GROUP BY 1")
def histogram_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_table(spark, sf_dir, "documents"), "n_chars")


_SPLIT = "WITH j AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)), m AS (SELECT median(n_chars) AS m FROM j) SELECT CAST(count(*) FILTER (n_chars > m AND quality = 1) AS BIGINT) AS above_yes, CAST(count(*) FILTER (n_chars > m AND quality = 0) AS BIGINT) AS above_no, CAST(count(*) FILTER (n_chars <= m AND quality = 1) AS BIGINT) AS below_yes, CAST(count(*) FILTER (n_chars <= m AND quality = 0) AS BIGINT) AS below_no FROM j, m"


@query(_SPLIT)
def median_split_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.median_split(_labelled(spark, sf_dir).withColumn("yes", F.col("quality") == 1), "n_chars", "yes")


@query()
def median_split_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = median_split_contingency(spark, sf_dir)
    return counts.withColumn("p_value", stats.fisher_p("above_yes", "above_no", "below_yes", "below_no"))


@query("SELECT role, CAST(sum(CAST(floor(len([w FOR w IN regexp_split_to_array(text, '\\s+') IF w <> '']) * 1.3) AS BIGINT)) AS BIGINT) AS tokens, CAST(floor(sum(floor((CAST(floor(len([w FOR w IN regexp_split_to_array(text, '\\s+') IF w <> '']) * 1.3) AS BIGINT) / 1e6 * 0.4 + 100 / 1e6 * 1.6) * 1e6 + 0.5)) + 0.5) AS BIGINT) AS cost_micro FROM conversations GROUP BY role")
def token_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("role", stats.token_estimate("text").alias("tokens"))
    cost = stats.token_cost(F.lit("gpt-4.1-mini"), F.col("tokens"), F.lit(100))
    return rows.groupBy("role").agg(F.sum("tokens").alias("tokens"), F.sum(F.floor(cost * 1e6 + 0.5)).cast("long").alias("cost_micro"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS calls, CAST(sum(CAST(floor(value * 1e6 + 0.5) AS BIGINT)) AS BIGINT) AS total_micro FROM events GROUP BY event_type")
def spending_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(_ppm("value")).alias("total_micro"))


# ---- joins and tables

@query("WITH a AS (SELECT doc_id AS k, length(text) AS l FROM documents), b AS (SELECT doc_id AS k, quality AS r FROM labels) SELECT CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(l), 0) AS BIGINT) AS chars FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def outer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("v"))
    out = analysis.outer_compared(a, _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("v")), "doc_id", "v")
    return out.groupBy("side").agg(F.count("*").alias("n"), F.coalesce(F.sum("left"), F.lit(0)).alias("chars"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def skip_existing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.not_done(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ["doc_id"]).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))")
def containment_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_in(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark").withColumnRenamed("text", "b"), "text", "b").select("doc_id", "source")


@query("SELECT source, doc_id, CAST(r AS BIGINT) AS rank, CAST(n_chars AS BIGINT) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return analysis.top(rows, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 5).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT lang, " + ", ".join(f"CAST(count(*) FILTER (quality = {q}) AS BIGINT) AS q{q}_n, CAST(sum(n_chars) FILTER (quality = {q}) AS BIGINT) AS q{q}_chars" for q in (0, 1)) + " FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def table_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("q", F.concat(F.lit("q"), F.col("quality")))
    out = analysis.table(rows, "lang", "q", ["q0", "q1"], n=F.count("doc_id"), chars=F.sum("n_chars"))
    return out.select("lang", *[F.coalesce(c, F.lit(0)).alias(c) if c.endswith("_n") else F.col(c) for c in ("q0_n", "q0_chars", "q1_n", "q1_chars")])


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS members, min(doc_id) AS first_member, max(doc_id) AS last_member FROM l GROUP BY line HAVING count(*) > 1")
def question_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.explode(chunking.units("text")).alias("line"))
    return analysis.repeated(lines, "line", "doc_id")


@query("SELECT source, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT doc_id) AS BIGINT) AS items, CAST(floor(count(*) / count(DISTINCT doc_id) * 1e6 + 0.5) AS BIGINT) AS rows_per_item_ppm FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) FROM documents) GROUP BY source")
def run_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(chunking.units("text")))
    return analysis.run_counts(lines, "source", "doc_id").select("source", "rows", "items", _ppm("rows_per_item").alias("rows_per_item_ppm"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, count(*) = count(DISTINCT doc_id) AS unique_keys FROM documents GROUP BY lang")
def split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.split_distribution(_table(spark, sf_dir, "documents"), "lang", "doc_id")


# ---- text

_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(replace(replace(replace(strip_accents(lower({0})), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), '''s$', ''), '&', 'and'), '^(the |a |an |la |le |il |el |los |las )', ''), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"WITH w AS (SELECT doc_id, lang, unnest(regexp_split_to_array(text, '[,\\n]')) AS e FROM documents) SELECT lang, {_NORM.format('e')} AS norm, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1, 2")
def entity_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "[,\n]", -1)).alias("e"))
    return parts.groupBy("lang", text.normalize_entity("e").alias("norm")).agg(F.count("*").alias("n"))


_CAPS = "list_distinct(regexp_extract_all({0}, '[A-Z][a-z]+'))"


@query(
    f"""WITH t AS (SELECT conv_id, arg_max({_CAPS.format('text')}, turn) AS a FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, list_distinct(flatten(list({_CAPS.format('text')}))) AS b FROM conversations GROUP BY conv_id),
m AS (SELECT conv_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS p FROM t JOIN s USING (conv_id))
SELECT conv_id, CAST(na AS BIGINT) AS n_summary, CAST(nb AS BIGINT) AS n_source, CAST(p AS BIGINT) AS pairs, CAST(floor(CASE WHEN nb > 0 THEN p / nb ELSE 0 END * 1e6 + 0.5) AS BIGINT) AS recall_ppm, CAST(floor(CASE WHEN na + nb - p > 0 THEN p / (na + nb - p) ELSE 0 END * 1e6 + 0.5) AS BIGINT) AS jaccard_ppm FROM m"""
)
def entity_exact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").withColumn("e", F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))))
    source = rows.select("conv_id", F.explode("e").alias("entity")).distinct().withColumn("ord", F.lit(0))
    last = analysis.last_of(rows, ["conv_id"], [F.col("turn").desc()])
    summary = last.select("conv_id", F.explode("e").alias("entity"))
    # names differ in their first letter's case only if they differ: equal normalised names are equal names here
    pairs = entities.exact_pairs(summary, source, "conv_id").groupBy("conv_id").agg(F.count("*").alias("pairs"))
    n = source.groupBy("conv_id").agg(F.count("*").alias("n_source"))
    zero = F.lit(0).cast("long")
    both = last.select("conv_id", F.size("e").cast("long").alias("n_summary")).join(n, "conv_id", "left").join(pairs, "conv_id", "left").select("conv_id", "n_summary", F.coalesce("n_source", zero).alias("n_source"), F.coalesce("pairs", zero).alias("pairs"))
    out = both.withColumn("c", entities.coverage("pairs", "n_summary", "n_source"))
    return out.select("conv_id", "n_summary", "n_source", "pairs", _ppm("c.recall").alias("recall_ppm"), _ppm("c.jaccard").alias("jaccard_ppm"))


@query()
def entity_fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each conversation's last turn and the names of the turns before it that are most like them."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", entities.recognised("text").alias("e"))
    told = rows.withColumn("is_last", F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id")))
    each = told.select("conv_id", "turn", "is_last", F.posexplode("e").alias("pos", "entity")).select("conv_id", "is_last", F.struct("turn", "pos").alias("ord"), "entity")
    return entities.fuzzy_pairs(each.where("is_last").select("conv_id", "entity").distinct(), each.where("not is_last"), "conv_id").withColumn("ratio", _ppm("ratio"))


@query("WITH p AS (SELECT doc_id, unnest(u) AS w, generate_subscripts(u, 1) AS i FROM (SELECT doc_id, string_split(text, ' ') AS u FROM documents)), f AS (SELECT doc_id, w, min(i) AS i FROM p GROUP BY doc_id, w) SELECT doc_id, md5(string_agg(w, '|' ORDER BY i)) AS digest, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY doc_id")
def entity_dedup_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split("text", " ", -1)).alias("w"))
    return rows.select("doc_id", F.md5(F.array_join("w", "|").cast("binary")).alias("digest"), F.size("w").cast("long").alias("n"))


_CLAIMS = "[c FOR c IN [trim(regexp_replace(trim(ltrim(trim(l), '- *•')), '^\\d+\\.\\s*', '')) FOR l IN string_split(replace(trim(text), '. ', chr(10) || '- 1. '), chr(10))] IF c <> '' AND lower(c) NOT IN ('claims:', 'claims', 'extracted claims:')]"


@query(f"WITH c AS (SELECT conv_id, turn, {_CLAIMS} AS c FROM conversations) SELECT conv_id, turn, CAST(len(c) AS BIGINT) AS claims, md5(array_to_string(c, '|')) AS digest FROM c")
def claims_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.parse_claims(F.replace("text", F.lit(". "), F.lit("\n- 1. "))).alias("c"))
    return rows.select("conv_id", "turn", F.size("c").cast("long").alias("claims"), F.md5(F.array_join("c", "|").cast("binary")).alias("digest"))


@query(f"WITH c AS (SELECT conv_id, turn, {_CLAIMS}[1:2] AS c FROM conversations) SELECT conv_id, turn, CAST(unnest(range(len(c))) AS BIGINT) AS claim_index, unnest(c) AS claim FROM c")
def claim_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.parse_claims(F.replace("text", F.lit(". "), F.lit("\n- 1. "))).alias("claims"))
    return claims.exploded(rows, "conv_id", "turn", stop=2).withColumn("claim_index", F.col("claim_index").cast("long"))


@query("WITH t AS (SELECT conv_id, turn, 'x <CULPRIT> ' || text || '</culprit> y <Evidence>' || role || chr(10) || '</EVIDENCE>' AS t FROM conversations) SELECT conv_id, turn, md5(trim(regexp_extract(t, '(?is)<CULPRIT>(.*?)</CULPRIT>', 1), ' ' || chr(10) || chr(9) || chr(13))) AS culprit, trim(regexp_extract(t, '(?is)<EVIDENCE>(.*?)</EVIDENCE>', 1), ' ' || chr(10)) AS evidence, '' AS accomplice FROM t")
def tagged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("x <CULPRIT> "), F.col("text"), F.lit("</culprit> y <Evidence>"), F.col("role"), F.lit("\n</EVIDENCE>"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", assessment.solution(t, {"culprit": "CULPRIT", "evidence": "EVIDENCE", "accomplice": "ACCOMPLICE"}).alias("s"))
    return rows.select("conv_id", "turn", F.md5(F.col("s.culprit").cast("binary")).alias("culprit"), "s.evidence", "s.accomplice")


@query(
    """SELECT doc_id, unnest(['culprit_correct', 'culprit_minor_missing_part_of_name', 'culprit_major_included_other_non_accomplice_suspects']) AS field,
unnest([CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END, CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END, 'N/A']) AS value FROM labels"""
)
def assessment_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes = lambda c: F.when(F.col(c) == 1, "Yes").otherwise("No")
    told = F.concat(F.lit('CULPRIT ASSESSMENT:\n```json\n{"culprit-correct": "'), yes("quality"), F.lit('", }\n```\nCULPRIT MINOR ERRORS: {"missing-part-of-name": "'), yes("toxic"), F.lit('" # said so\n}\nCULPRIT MAJOR ERRORS:\n{"included_other_non_accomplice_suspects": "N/A"}'))
    rows = _table(spark, sf_dir, "labels").select("doc_id", assessment.parsed_assessment(told, "culprit").alias("p"))
    return assessment.flattened(rows, "doc_id", "culprit", "p")


@query("WITH d AS (SELECT doc_id, [regexp_replace(l, '^\\[\\d+\\]\\s*', '') FOR l IN string_split(text, chr(10))] AS u FROM documents), p AS (SELECT *, CAST(floor(len(u) * 0.85) AS BIGINT) + 1 AS k FROM d) SELECT doc_id, CAST(length(array_to_string(u[1 : k - 1], chr(10))) AS BIGINT) AS content_chars, CAST(length(array_to_string(u[k : len(u)], chr(10))) AS BIGINT) AS reveal_chars FROM p")
def line_split_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text", (F.floor(F.size(chunking.units("text")) * 0.85) + 1).cast("int").alias("at"))
    out = rows.select("doc_id", text.split_at_line("text", "at").alias("s"))
    return out.select("doc_id", F.length("s.content").cast("long").alias("content_chars"), F.length("s.reveal").cast("long").alias("reveal_chars"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, 'of the', 'OF THE'), '\\bThe\\b', 'Thee', 'g'), '\\band\\b', 'AND', 'g')) AS digest, CAST((length(text) - length(replace(text, 'of the', ''))) // 6 AS BIGINT) AS n FROM documents")
def name_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(text.corrected("text", {"of the": "OF THE", "The": "Thee", "and": "AND"}).cast("binary")).alias("digest"), text.occurrences("text", "of the", fold_case=False).alias("n"))


@query("WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS u FROM documents), l AS (SELECT doc_id, unnest(u) AS line, generate_subscripts(u, 1) AS k FROM d), n AS (SELECT doc_id, k, CASE WHEN k % 7 = 3 THEN NULL WHEN k % 11 = 5 THEN k + 1 ELSE k END AS n FROM l), b AS (SELECT *, last_value(n IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n) SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(count(n) AS BIGINT) AS numbered, CAST(arg_min(n, k) FILTER (n IS NOT NULL) AS BIGINT) AS first_number, CAST(count(*) FILTER (n <> before + 1) AS BIGINT) AS gaps, CAST(count(*) FILTER (n <> k) AS BIGINT) AS misplaced FROM b GROUP BY doc_id")
def line_number_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda at: F.when(at % 7 == 3, F.lit(None)).when(at % 11 == 5, at + 1).otherwise(at)
    marked = F.array_join(F.transform(chunking.units("text"), lambda line, i: F.concat(F.coalesce(F.concat(F.lit("["), number(i + 1).cast("string"), F.lit("] ")), F.lit("")), line)), "\n")
    return analysis.line_numbers(_table(spark, sf_dir, "documents").select("doc_id", marked.alias("t")), "doc_id", "t")


@query(
    "SELECT doc_id, c AS short FROM (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '<50' WHEN 1 THEN '<100' WHEN 2 THEN 'long' WHEN 3 THEN 'summary' WHEN 4 THEN '<' || CAST(doc_id AS VARCHAR) WHEN 5 THEN 'as brief a...' WHEN 6 THEN 'brief' ELSE 'unknown' END AS c FROM labels)"
)
def constraint_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 8
    told = F.when(k == 0, "Less than 50 words, a summary").when(k == 1, "in less than 100 words").when(k == 2, "a very long summary").when(k == 3, "a short Summary").when(k == 4, F.concat(F.lit("about "), F.col("doc_id").cast("string"), F.lit("  words please"))).when(k == 5, "as brief as can be").when(k == 6, "brief").otherwise("")
    return _table(spark, sf_dir, "labels").select("doc_id", text.short_constraint(told).alias("short"))


@query("SELECT page_id, CAST(length(html) - length(replace(html, '<p', '')) AS BIGINT) // 2 AS paragraphs, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages")
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", text.occurrences("html", "<p", fold_case=False).alias("paragraphs"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"))


@query("WITH l AS (SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'Yes' ELSE 'No' END AS q FROM documents), r AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'Yes' ELSE 'N/A' END AS q FROM labels) SELECT CASE WHEN r.doc_id IS NULL THEN 'left_only' WHEN l.doc_id IS NULL THEN 'right_only' WHEN l.q = replace(r.q, 'N/A', 'No') THEN 'same' ELSE 'different' END AS status, CAST(count(*) AS BIGINT) AS n FROM l FULL JOIN r USING (doc_id) GROUP BY 1")
def assessment_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one run's assessments (long ones are right), labels as another's."""
    yes = lambda c, no: F.when(c, "Yes").otherwise(no)
    a = _table(spark, sf_dir, "documents").select("doc_id", F.lit("culprit_correct").alias("field"), yes(F.col("n_chars") > 1000, "No").alias("value"))
    b = _table(spark, sf_dir, "labels").select("doc_id", F.lit("culprit_correct").alias("field"), yes(F.col("toxic") == 1, "N/A").alias("value"))
    return assessment.compared(a, b, ["doc_id", "field"])


@query("WITH t AS (SELECT lang, 1.0 / len([x FOR x IN string_split(text, ',') IF trim(x) <> '']) AS p FROM documents WHERE len([x FOR x IN string_split(text, ',') IF trim(x) <> '']) > 0) SELECT lang, CAST(floor(avg(p) * 1e6 + 0.5) AS BIGINT) AS guess_ppm FROM t GROUP BY lang")
def random_guess_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(_ppm(stats.random_guess("text")).alias("guess_ppm"))


@query("SELECT doc_id, substr(text, 1, 89) || CASE WHEN length(text) > 89 THEN '...' ELSE '' END AS shortened, split_part(source || '_' || lang, '_', 1) AS dataset FROM documents")
def field_shaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.shortened("text").alias("shortened"), text.dataset_name(F.concat(F.lit("outputs/"), "source", F.lit("_"), "lang", F.lit("/"))).alias("dataset"))


@query("WITH w AS (SELECT lang, [x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> ''] AS w FROM documents) SELECT lang, CAST(sum(len(w)) AS BIGINT) AS words, CAST(count(*) AS BIGINT) AS items FROM w GROUP BY lang")
def item_word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang", chunking.units("text").alias("chunks"))
    counted = analysis.item_word_counts(rows.withColumn("item", F.struct("lang", "doc_id")), "item", "chunks")
    return counted.groupBy(F.col("item.lang").alias("lang")).agg(F.sum("words").alias("words"), F.count("*").alias("items"))
