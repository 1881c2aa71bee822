"""Comparisons of experiments on rows that are odd: nulls, repeats, nothing at all."""

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import experiments as ex


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lookup_of_the_source(spark):
    runs = spark.createDataFrame([("r1", "a"), ("r2", "b"), ("r3", None), ("r4", "gone")], "run string, source_collection string")
    sources = spark.createDataFrame([("a", "", "flat"), ("b", None, None)], "collection string, nested string, flat string")
    assert rows(ex.with_source(runs, sources, length=("nested", "flat")).select("run", "source_length")) == [("r1", "flat"), ("r2", None)]


def test_methods_side_by_side(spark):
    data = [("s", 1, "x", 1.0), ("s", 1, "y", 3.0), ("t", 1, "x", 3.0), ("t", 1, "y", 5.0), ("u", 1, "x", 9.0), ("s", 2, "x", 7.0), ("s", 1, "z", 0.0), ("s", 1, "x", None)]
    df = spark.createDataFrame(data, "item string, at int, method string, v double")
    (row,) = ex.methods_side_by_side(df, "item", "at", "method", "v", ("x", "y")).collect()
    assert (row["at"], row.x_n, row.x_mean, row.y_n, row.y_mean) == (1, 2, 2.0, 2, 4.0) and abs(row.x_sem - 1 / 2**0.5) < 1e-12
    assert ex.methods_side_by_side(df.where("false"), "item", "at", "method", "v", ("x", "y")).isEmpty()


def test_content_split_check(spark):
    old = spark.createDataFrame([(1, "[1] a\n[2] b"), (2, "[1] a\n[2]  b"), (3, "no numbers"), (4, None)], "k int, content string")
    new = spark.createDataFrame([(1, "b\nc", 2), (2, "x", 2), (3, "b", 1), (4, "b", 1), (5, "b", 1)], "k int, reveal string, answer_position int")
    assert rows(ex.content_split_check(old, new, "k")) == [(1, "same"), (2, "different"), (3, "no such line"), (4, "no such line")]


def test_difference_quality(spark):
    trusted = spark.createDataFrame([("i", "Ann", "Ann"), ("i", "Bob", "Robert"), ("i", "Bob", "Robert"), ("i", None, "x"), ("j", "Eve", "Eve")], "i string, summary_entity string, source_entity string")
    other = spark.createDataFrame([("i", "Ann", "Ann Lee"), ("i", "Cy", "cyrus"), ("i", "Di", "Fox")], "i string, summary_entity string, source_entity string")
    told = ex.difference_quality(trusted, other, "i")
    assert rows(told) == [
        ("i", "Ann", "Ann Lee", "extra", True), ("i", "Ann", "Ann", "missing", True), ("i", "Bob", "Robert", "missing", False),
        ("i", "Cy", "cyrus", "extra", True), ("i", "Di", "Fox", "extra", False), ("j", "Eve", "Eve", "missing", False),
    ]
    assert rows(ex.difference_shares(told)) == [(6, 3, 3, 50.0, 50.0)] and rows(ex.difference_shares(told.where("false"))) == [(0, 0, 0, 0.0, 0.0)]


def test_scopes_and_items(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "item_id string, doc_index int")
    assert ex.in_scope(df, "doc_range", item_id="a", doc_range="1").collect()[0].doc_index == 1
    for bad in ({"scope": "item"}, {"scope": "doc_range", "item_id": "a"}, {"scope": "shelf"}):
        with pytest.raises(ValueError):
            ex.in_scope(df, **bad)
    assert ex.of_items(df, ["a", "z"]).count() == 2
    with pytest.raises(ValueError, match="z"):
        ex.of_items(df, ["a", "z"], strict=True)


def test_documents_as_one_and_stored_statistics(spark):
    df = spark.createDataFrame([("a", 1, "y", ["y"], 1), ("a", 0, "x", ["x", "reveal"], 1), ("b", 0, None, None, None)], "item string, n int, content string, chunks array<string>, total_chars long")
    assert rows(ex.concatenated_documents(df, "item", "n", "content", "|")) == [("a", "x|y"), ("b", "")]
    assert rows(ex.chunked_item_statistics(df, "item")) == [("a", 2, 3, 2, 0.7), ("b", 1, 0, 0, 0.0)]


def test_truth_by_collection(spark):
    meta = F.create_map(F.lit("culprit(s), human annotated"), F.lit("M"))
    q = F.expr("named_struct('question', ' who ', 'answer', a, 'options', map('A', 'A - N'))")
    df = spark.createDataFrame([("A",), ("B",), (None,)], "a string")
    assert [r.t.culprits for r in df.select(ex.truth_of("detectiveqa_x", meta, question=q).alias("t")).collect()] == ["N", "M", "M"]
    (t,) = df.limit(1).select(ex.truth_of("true-detective", meta, answer_options=F.lit("(a) N")).alias("t")).collect()
    assert (t.t.culprits, t.t.suspects, t.t.murder_question) == ("M", "(a) N", None)


def test_cache_rescore_and_score(spark, tmp_path):
    df, asked = spark.range(6).withColumnRenamed("id", "k"), []

    def make(missing):
        asked.append(missing.count())
        return missing.withColumn("v", F.col("k") * 2)

    for some in (df.where("k < 2"), df, df):
        out = ex.cached(some, f"{tmp_path}/t", ["k"], make)
    assert asked == [2, 4] and out.count() == 6
    scored = spark.createDataFrame([(0, "yes"), (1, None)], "k long, a string")
    assert ex.to_score(df, scored, "k", "a").count() == 5 and ex.to_score(df, scored, "k", "a", rescore=True).count() == 6
    texts = spark.createDataFrame([("1.5",), ("none",), (None,)], "t string")
    assert sorted(r.score for r in ex.rated(texts, "t", list).collect()) == [0.0, 0.0, 1.5]


def test_runs_and_keys(spark):
    def run(name):
        if name == "b":
            raise KeyError(name)

    assert ex.fanned_out("abc", run) == {"a": None, "b": "KeyError: 'b'", "c": None}
    with pytest.raises(KeyError):
        ex.fanned_out("abc", run, stop_at_failure=True)
    assert ex.command(["x/__main__.py", "whodunit", "--stop", "3"], "tool") == "python -m tool whodunit --stop 3"
    df = spark.createDataFrame([('{"a-b": "c-d", "e": {"f-g": -1, "h": ["i-j"]}}',), (None,)], "j string")
    assert [r[0] for r in df.select(ex.underscored_keys("j")).collect()] == ['{"a_b": "c-d", "e": {"f_g": -1, "h": ["i-j"]}}', None]
