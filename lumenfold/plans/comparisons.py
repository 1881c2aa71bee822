"""Registered queries that compare experiments, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, experiments, overlap
from ..sources.scratch import folder as scratch
from .queries import _CAPS, _LAG, _grams_sql, _ppm, _table, query


@query("SELECT c_custkey, n_name AS source_length FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1 UNION ALL SELECT c_custkey, 'R' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def source_collection_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as evaluation runs, nations as collections that keep their length in one of two places."""
    nested = F.when(F.col("n_regionkey") == 1, "").otherwise(F.col("n_name"))
    found = _table(spark, sf_dir, "nation").select("n_nationkey", nested.alias("nested"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("flat"))
    runs = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return experiments.with_source(runs, found, source="c_nationkey", name="n_nationkey", length=("nested", "flat")).select("c_custkey", "source_length")


@query("SELECT doc_id, 'docs_' || source || '_concat' AS summary_run, CAST(n AS BIGINT) AS items FROM documents JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source)")
def claims_to_summary_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of claims meet the summary runs that they come from by name."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    claims = docs.select("doc_id", F.concat(F.lit("docs_"), "source", F.lit("_concat" + experiments.CLAIMS_SUFFIX)).alias("run"))
    summaries = docs.groupBy(F.concat(F.lit("docs_"), "source", F.lit("_concat")).alias("summary_run")).agg(F.count("*").alias("items"))
    return claims.select("doc_id", experiments.summary_run_of("run").alias("summary_run")).join(summaries, "summary_run")


@query(
    """WITH r AS (SELECT conv_id, turn // 2 AS p, role, CAST(length(text) AS BIGINT) AS v FROM conversations WHERE role IN ('user', 'assistant')),
s AS (SELECT r.* FROM r JOIN (SELECT conv_id FROM r GROUP BY conv_id HAVING count(DISTINCT role) = 2) USING (conv_id))
SELECT p AS position, count(*) FILTER (role = 'user') AS user_n, CAST(floor(avg(v) FILTER (role = 'user') * 1e6 + 0.5) AS BIGINT) AS user_mean, CAST(floor(stddev_pop(v) FILTER (role = 'user') / sqrt(count(*) FILTER (role = 'user')) * 1e3 + 0.5) AS BIGINT) AS user_sem,
count(*) FILTER (role = 'assistant') AS assistant_n, CAST(floor(avg(v) FILTER (role = 'assistant') * 1e6 + 0.5) AS BIGINT) AS assistant_mean, CAST(floor(stddev_pop(v) FILTER (role = 'assistant') / sqrt(count(*) FILTER (role = 'assistant')) * 1e3 + 0.5) AS BIGINT) AS assistant_sem FROM s GROUP BY 1 HAVING count(DISTINCT role) = 2"""
)
def methods_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of questions and answers, as two methods, at each exchange of conversations that have both."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("position"), "role", F.length("text").cast("long").alias("v"))
    out = experiments.methods_side_by_side(rows, "conv_id", "position", "role", "v", ("user", "assistant"))
    milli = lambda c: F.floor(F.col(c) * 1e3 + 0.5).cast("long").alias(c)
    return out.select("position", "user_n", _ppm("user_mean").alias("user_mean"), milli("user_sem"), "assistant_n", _ppm("assistant_mean").alias("assistant_mean"), milli("assistant_sem"))


_NUMBERED = "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS u FROM documents), n AS (SELECT doc_id, u, CAST(length(doc_id::VARCHAR) AS BIGINT) + 1 AS k FROM l)"


@query(_NUMBERED + " SELECT doc_id, CASE WHEN len(u) < k THEN 'no such line' WHEN u[k] = u[1] THEN 'same' ELSE 'different' END AS status FROM n")
def content_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with numbered lines against a reveal that starts with their first line; the answer's number grows with the id's length."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.ltrim(x)))
    old = docs.select("doc_id", F.array_join(numbered, "\n").alias("content"))
    first = F.ltrim(F.substring_index("text", "\n", 1))
    new = docs.select("doc_id", F.concat(first, F.lit("\nand so on")).alias("reveal"), (F.length(F.col("doc_id").cast("string")) + 1).alias("answer_position"))
    return experiments.content_split_check(old, new, "doc_id")


@query("SELECT spec AS range_spec, CAST(count(*) AS BIGINT) AS n FROM (SELECT ['last', 'all', '1', '2-3', 'penultimate', 'x'][CAST(doc_id % 6 AS INT) + 1] AS spec FROM documents) WHERE spec IN ('penultimate', 'last', 'all', 'all-but-last', '1') GROUP BY 1")
def report_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = F.array(*map(F.lit, ("last", "all", "1", "2-3", "penultimate", "x")))
    rows = _table(spark, sf_dir, "documents").select(F.get(specs, (F.col("doc_id") % 6).cast("int")).alias("range_spec"))
    return experiments.of_ranges(rows).groupBy("range_spec").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE value > 0 GROUP BY 1")
def positive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.positive(_table(spark, sf_dir, "events"), "value").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT n AS turns, count(*) AS items FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) GROUP BY n")
def count_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return experiments.count_distribution(counted, "turns")


@query("SELECT o_custkey, count(*) AS n, md5(string_agg(o_orderpriority, '|' ORDER BY o_orderpriority)) AS questions FROM orders GROUP BY o_custkey")
def questions_by_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as novels, their orders' priorities as questions."""
    out = experiments.questions_by_novel(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")
    return out.select("o_custkey", "n", F.md5(F.array_join("questions", "|")).alias("questions"))


@query("SELECT source, lang, count(*) AS items, CAST(floor(avg(CASE WHEN lang = 'de' THEN length(text) / 5 ELSE len([w FOR w IN regexp_split_to_array(text, '\\s+') IF w <> '']) END) * 1e3 + 0.5) AS BIGINT) AS words, CAST(floor(avg(length(text)) * 1e3 + 0.5) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def words_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as runs, languages as ranges; in one of them words are estimated."""
    out = experiments.words_by_range(_table(spark, sf_dir, "documents"), "source", "lang", "text", estimated=F.col("lang") == "de")
    return out.select("source", "lang", "items", *[F.floor(F.col(c) * 1e3 + 0.5).cast("long").alias(c) for c in ("words", "chars")])


@query("SELECT event_type, count(*) AS n, CAST(floor(avg(v) * 100 + 0.5) AS BIGINT) AS mean, CAST(list_sort(list(v))[count(*) // 2 + 1] * 100 AS BIGINT) AS median, CAST(min(v) * 100 AS BIGINT) AS min, CAST(max(v) * 100 AS BIGINT) AS max FROM (SELECT event_type, CAST(floor(value) AS BIGINT) AS v FROM events) GROUP BY 1")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_type", F.floor("value").cast("long").alias("v"))
    out = experiments.metric_summary(rows, "event_type", "v")
    return out.select("event_type", "n", *[F.floor(F.col(c) * 100 + 0.5).cast("long").alias(c) for c in ("mean", "median", "min", "max")])


def _words_with_capitals() -> Column:
    return F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))


_MATCHES = f"m AS (SELECT conv_id, role, unnest(list_distinct({_CAPS.format('text')})) AS s FROM conversations), t AS (SELECT DISTINCT conv_id, s, upper(s) AS r FROM m WHERE role = 'user'), o AS (SELECT DISTINCT conv_id, s, CASE WHEN length(s) % 2 = 0 THEN upper(s) ELSE 'Z' || reverse(s) END AS r FROM m WHERE role <> 'user')"
_LIKE = "(contains({0}.r, {1}.r) OR contains({1}.r, {0}.r) OR contains({0}.s, {1}.s) OR contains({1}.s, {0}.s))"


@query(
    "WITH " + _MATCHES + f""", d AS (SELECT 'missing' AS side, EXISTS (SELECT 1 FROM o WHERE o.conv_id = t.conv_id AND {_LIKE.format('t', 'o')}) AS good FROM t WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.conv_id = t.conv_id AND o.s = t.s AND o.r = t.r)
UNION ALL SELECT 'extra', EXISTS (SELECT 1 FROM t WHERE o.conv_id = t.conv_id AND {_LIKE.format('t', 'o')}) OR contains(lower(r), lower(s)) OR contains(lower(s), lower(r)) FROM o WHERE NOT EXISTS (SELECT 1 FROM t WHERE o.conv_id = t.conv_id AND o.s = t.s AND o.r = t.r))
SELECT count(*) AS total, count(*) FILTER (good) AS reasonable, count(*) FILTER (NOT good) AS concerning, CAST(coalesce(floor(count(*) FILTER (good) / count(*) * 1e8 + 0.5), 0) AS BIGINT) AS reasonable_pct FROM d"""
)
def match_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two made-up systems that match capitalised words: one those of the user, the other those of all others."""
    names = _table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(_words_with_capitals()).alias("summary_entity"))
    s = F.col("summary_entity")
    trusted = names.where("role = 'user'").select("conv_id", s, F.upper(s).alias("source_entity"))
    other = names.where("role <> 'user'").select("conv_id", s, F.when(F.length(s) % 2 == 0, F.upper(s)).otherwise(F.concat(F.lit("Z"), F.reverse(s))).alias("source_entity"))
    told = experiments.difference_shares(experiments.difference_quality(trusted, other, "conv_id"))
    return told.select("total", "reasonable", "concerning", _ppm("reasonable_pct").alias("reasonable_pct"))


@query("WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, string_split(text, chr(10)) AS u FROM documents) SELECT 'dataset' AS scope, CAST(sum(len(u)) AS BIGINT) AS chunks FROM c UNION ALL SELECT 'item', CAST(sum(len(u)) AS BIGINT) FROM c WHERE item_id = '7' UNION ALL SELECT 'doc_range', CAST(sum(least(len(u), 3)) AS BIGINT) FROM c WHERE item_id = '7'")
def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as documents of one chunk each, by the three scopes."""
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("item_id"), F.posexplode(chunking.units("text")).alias("doc_index", "chunk"))
    asked = (("dataset", {}), ("item", {"item_id": "7"}), ("doc_range", {"item_id": "7", "doc_range": "0-2"}))
    out = None
    for scope, given in asked:
        some = experiments.in_scope(chunks, scope, **given).agg(F.count("*").alias("chunks")).select(F.lit(scope).alias("scope"), "chunks")
        out = some if out is None else out.unionByName(some)
    return out


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id")
def concatenated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = experiments.concatenated_documents(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", F.md5("text").alias("digest"))


@query("SELECT lang, count(*) AS num_documents, CAST(sum(len(string_split(text, chr(10))) + 1) AS BIGINT) AS total_chunks, CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(floor(sum(length(text)) / sum(len(string_split(text, chr(10))) + 1) * 10 + 0.5) AS BIGINT) AS avg_chunk_size FROM documents GROUP BY lang")
def chunked_item_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as items, lines as chunks, and a reveal after each document's."""
    rows = _table(spark, sf_dir, "documents").select("lang", F.array_append(chunking.units("text"), F.lit("so it was")).alias("chunks"), F.length("text").cast("long").alias("total_chars"))
    out = experiments.chunked_item_statistics(rows, "lang")
    return out.withColumn("avg_chunk_size", F.floor(F.col("avg_chunk_size") * 10 + 0.5).cast("long"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url END AS culprits, CASE WHEN page_id % 2 = 0 THEN NULL ELSE 'helper' END AS accomplices, 'We unfortunately do not have a list of suspects for this story.' AS suspects, 'Who was it?' AS murder_question FROM pages")
def ground_truth_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as items of a collection of questions; every second question's answer is none of its options."""
    options = F.create_map(F.lit("A"), F.concat(F.lit("A - "), "url"), F.lit("B"), F.lit("B - another"))
    q = F.struct(F.lit(" Who was it? ").alias("question"), F.when(F.col("page_id") % 2 == 0, "A").otherwise("C").alias("answer"), options.alias("options"))
    told = experiments.truth_of("detectiveqa", F.create_map(F.lit("accomplice(s), human annotated"), F.lit("helper")), question=q)
    return _table(spark, sf_dir, "pages").select("page_id", told.alias("t")).select("page_id", "t.culprits", "t.accomplices", "t.suspects", "t.murder_question")


@query("SELECT doc_id, 'first' AS round FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT doc_id, 'again' FROM documents")
def items_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as solved items; labels of quality are assessments, others have none."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 1).alias("a"))
    first = experiments.to_score(docs, labels, "doc_id", "a").withColumn("round", F.lit("first"))
    return first.unionByName(experiments.to_score(docs, labels, "doc_id", "a", rescore=True).withColumn("round", F.lit("again")))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN CAST(length(text) AS BIGINT) ELSE 0 END AS score FROM conversations")
def provider_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in scorer that tells the length of users' turns, and fails on the others'."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(":"), "text").alias("t"))
    out = experiments.rated(rows, "t", _length_of_users)
    return out.select("conv_id", "turn", F.col("score").cast("long").alias("score"))


def _length_of_users(prompts: list[str]) -> list[str]:
    return [str(len(p) - 5) if p.startswith("user:") else "no score" for p in prompts]


@query("""SELECT page_id, '{"a_b":{"c_d":"x-y: ' || page_id || '","e":[{"f_g":-1}]}}' AS value FROM pages""")
def nested_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit('{"a-b":{"c-d":"x-y: '), F.col("page_id").cast("string"), F.lit('","e":[{"f-g":-1}]}}'))
    return _table(spark, sf_dir, "pages").select("page_id", experiments.underscored_keys(made).alias("value"))


@query(f"SELECT conv_id, turn, CAST(len({_CAPS.format('text')}) AS BIGINT) AS names FROM conversations")
def cached_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of half the conversations first, then of those that the table lacks: each text is looked at once."""
    at, rows = scratch(spark, "entity-cache"), _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    for some in (rows.where("turn % 2 = 0"), rows):
        experiments.cached(some, at, ["conv_id", "turn"], lambda missing: missing.select("conv_id", "turn", F.size(_words_with_capitals()).cast("long").alias("names")))
    return spark.read.parquet(at)


@query(
    "WITH " + _LAG + _grams_sql(1, "SELECT conv_id, turn, 0 AS side, target AS text FROM pairs UNION ALL SELECT conv_id, turn, 1, prediction FROM pairs", "conv_id,turn")
    + ", s AS (SELECT p.conv_id, CASE WHEN np > 0 THEN o / np ELSE 0 END AS v FROM pairs p LEFT JOIN sums USING (conv_id, turn)) SELECT conv_id, CAST(count(*) AS BIGINT) AS points, CAST(floor(avg(v) * 1e6 + 0.5) AS BIGINT) AS precision FROM s WHERE v > 0 GROUP BY conv_id"
)
def positive_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean continuity of each conversation over the steps that share a word with the one before."""
    pairs = overlap.adjacent(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    steps = overlap.rouge_n(pairs, 1, keys=["conv_id", "turn"]).select("conv_id", "score.precision")
    return experiments.positive(steps, "precision").groupBy("conv_id").agg(F.count("*").alias("points"), _ppm(F.avg("precision")).alias("precision"))
