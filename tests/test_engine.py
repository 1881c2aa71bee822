"""The engine's operators against plain restatements of their rules, and on the edge cases that they name."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import ranges, stats, text
from lumenfold.operators import analysis, assessment, chunking, claims, entities, overlap, stemmer, summarize
from lumenfold.providers import PROVIDERS, get
from lumenfold.sources import collections, sinks
from lumenfold.streaming import fold


def one(spark, schema, rows, *columns):
    return [tuple(x) for x in spark.createDataFrame(rows, schema).select(*columns).collect()]


# ---- chunking


def plain_pack(units, size, joiner):
    out, open_, used = [], [], 0
    for u in units:
        total = used + len(u) + (len(joiner) if open_ else 0)
        if open_ and total > size:
            out.append(joiner.join(open_))
            open_, used = [u], len(u)
        else:
            open_.append(u)
            used = total
    return [*out, joiner.join(open_)]


def plain_chunks(t, size, joiner, least):
    units = t.split(joiner)
    out = plain_pack(units, size, joiner)
    if len(out) > 1:
        last = len(out[-1])
        if last < least:
            out[-2:] = [out[-2] + joiner + out[-1]]
        elif last <= 0.5 * size:
            out = plain_pack(units, int((size * (len(out) - 1) + last) / (len(out) - 1)), joiner)
            if len(out) > 1 and len(out[-1]) < 1.5 * least:
                out[-2:] = [out[-2] + joiner + out[-1]]
    return out


@pytest.mark.parametrize(("size", "least"), [(300, 400), (1000, 100), (2000, 400), (3000, 300)])
def test_fixed_size_is_the_plain_rule(spark, size, least):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.contains("text", F.lit("\n"))).select("doc_id", "text")
    for x in chunking.fixed_size(docs, size, min_len=least).collect():
        assert x.chunks == plain_chunks(x.text, size, "\n", least) and "\n".join(x.chunks) == x.text


def test_chunking_edges(spark):
    rows = [(None,), ("",), ("abc",), ("\na\n\n",), ("x" * 50 + "\ny",), ("😀\n😀😀\nabcdef",)]
    df = spark.createDataFrame(rows, "text string")
    got = chunking.fixed_size(df, 4, rebalance=False).collect()
    assert [x.error for x in got[:3]] == ["text must be a string", "cannot chunk empty text", "delimiter not found in text"] and all(x.chunks is None for x in got[:3])
    assert [x.chunks for x in got[3:]] == [plain_pack(r[0].split("\n"), 4, "\n") for r in rows[3:]]
    ok, bad = chunking.split_errors(chunking.fixed_count(df, 1))
    assert ok.count() == 4 and bad.count() == 2 and all(x.chunks == [x.text] for x in ok.collect())
    many = chunking.chunk(df.where("text like '%\n%'"), "fixed_count", 40).collect()
    assert [x.chunks for x in many] == [x.text.split("\n") for x in many]
    dotted = chunking.fixed_size(spark.createDataFrame([("a.b..c",)], "text string"), 3, delimiter=".", rebalance=False).collect()[0]
    assert dotted.chunks == plain_pack("a.b..c".split("."), 3, ".")
    for bad_call in (lambda: chunking.fixed_size(df, 0), lambda: chunking.fixed_size(df, True), lambda: chunking.fixed_size(df, 5, delimiter=""), lambda: chunking.chunk(df, "custom", 3)):
        with pytest.raises(chunking.ChunkingError):
            bad_call()


def test_fixed_count_spreads_units(spark):
    t = "\n".join(map(str, range(11)))
    got = chunking.fixed_count(spark.createDataFrame([(t,)], "text string"), 4).collect()[0].chunks
    assert [len(c.split("\n")) for c in got] == [3, 3, 3, 2] and "\n".join(got) == t


def test_sentences_reveal_and_statistics(spark):
    df = spark.createDataFrame([("One two. Three four! Five?  Six.", "told"), ("A b. C d.", "")], "text string, reveal string")
    made = chunking.fixed_size(df, 20, sentence_mode=True, rebalance=False)
    assert [x.chunks for x in made.collect()] == [["One two. Three four!", "Five? Six."], ["A b. C d."]]
    assert made.select(chunking.preserved("text", "chunks", " ", normalize_whitespace=True)).distinct().collect() == [(True,)]
    got = chunking.with_reveal(made, "reveal").collect()
    assert got[0].chunks[-1] == "told" and got[0].stats.num_chunks == 2 and not got[1].reveal_added
    s = got[0].stats
    assert (s.total_chars, s.min_chunk_size, s.max_chunk_size, s.avg_chunk_size, s.size_std) == (30, 10, 20, 15.0, 5.0)
    total = chunking.collection_statistics(chunking.with_reveal(made, "reveal")).collect()[0]
    assert (total.documents, total.chunks) == (2, 3)
    assert made.select(chunking.previews(width=5)).head()[0][0] == "Chunk 1: One t..."
    items = chunking.item_statistics(chunking.with_reveal(made, "reveal").withColumn("item", F.lit("i")), "item").collect()[0]
    assert items.total_chunks == 3 and items.avg_chunk_size == 13.0


# ---- ranges


@pytest.mark.parametrize(
    ("dialect", "spec", "want"),
    [
        ("strict", "all", {0: None, 1: [1], 2: [1, 2], 5: [1, 2, 3, 4, 5]}),
        ("strict", "penultimate", {0: None, 1: None, 2: [1], 5: [4]}),
        ("strict", "all-but-last", {1: None, 2: [1], 5: [1, 2, 3, 4]}),
        ("strict", "2-4", {2: None, 5: [2, 3, 4]}),
        ("strict", "4-2", {5: None}),
        ("strict", "0", {5: None}),
        ("strict", "9", {5: None}),
        ("clamped", "penultimate", {0: None, 1: [0], 5: [3]}),
        ("clamped", "1-99", {0: None, 2: [0, 1]}),
        ("clamped", "all-but-last", {1: [0], 2: [0]}),
        ("single", "all", {0: None, 5: [4]}),
        ("single", "all-but-last", {1: [0], 5: [3]}),
        ("single", "2-4", {2: None, 5: [3]}),
        ("pairs", "all-but-last", {1: None, 2: [1]}),
        ("steps", "last", {5: [5]}),
        ("steps", "anything", {2: [1, 2]}),
    ],
)
def test_ranges(spark, dialect, spec, want):
    rows = [(n, [f"t{k}" for k in range(n)]) for n in want]
    got = dict(one(spark, "n int, a array<string>", rows, "n", ranges.select_range("a", spec, dialect).alias("r")))
    assert {n: r.positions for n, r in got.items()} == want
    assert all((r.range_error is None) == (r.positions is not None) for r in got.values())


def test_range_specifications():
    for dialect in ("strict", "clamped", "single"):
        with pytest.raises(ranges.RangeError):
            ranges.positions(F.array(), "x", dialect)
    with pytest.raises(ranges.RangeError):
        ranges.positions(F.array(), "last", "pairs")
    assert ranges.parse_document_range("0-2") == [0, 1, 2] and ranges.parse_document_range("0,2,2") == [0, 2] and ranges.parse_document_range("1") == [1]
    for bad in ("2-0", "0:2", "", "a"):
        with pytest.raises(ranges.RangeError):
            ranges.parse_document_range(bad)


def test_documents_and_expansion(spark):
    got = one(spark, "a array<string>", [(["x", "y", "z"],), ([],)], ranges.documents_in("a", "0,2,9"), ranges.expanded("a", 2))
    assert got == [(["x", "z"], [1, 2]), ([], [])]


# ---- text


def test_text_functions(spark):
    norm = dict(one(spark, "e string", [("The Duke's",), ("Smith & Co.",), ("Las Vegas",), ("theater",), ("É. d'Été",), ("",)], "e", text.normalize_entity("e")))
    assert norm == {"The Duke's": "duke", "Smith & Co.": "smith and co", "Las Vegas": "vegas", "theater": "theater", "É. d'Été": "e dete", "": ""}
    assert one(spark, "t string", [("- a\n* b\n• c\n1. d\n- 2. e\nClaims:\n\n   f  ",)], text.parse_claims("t"))[0][0] == ["a", "b", "c", "d", "e", "f"]
    assert one(spark, "t string", [("x <Culprit> a\nb </CULPRIT> <culprit>c</culprit>",), ("none",)], text.tagged("t", "CULPRIT")) == [("a\nb",), ("",)]
    assert one(spark, "t string", [(" a b\tc ",), ("",)], text.word_count("t")) == [(3,), (0,)]
    split = one(spark, "t string, p int", [("[1] a\n[2] b\n[3] c", 2)], text.split_at_line("t", "p"))[0][0]
    assert (split.content, split.reveal) == ("a", "b\nc")
    assert one(spark, "t string", [("Ann met Annabel and Old Ann",)], text.corrected("t", {"Old Ann": "Beth", "Ann": "Zoe"}))[0][0] == "Zoe met Annabel and Beth"
    assert one(spark, "t string", [("aXaxAA",)], text.occurrences("t", "ax"), text.occurrences("t", ""))[0] == (2, 0)
    names = one(spark, "t string", [("The Mary Jane's dog saw Bob and Bob. O",)], text.capitalised_names("t"))[0][0]
    assert "Bob" in names and names.count("Bob") == 1 and "O" not in names
    assert one(spark, "n string", [("Bob",), ("BOB",), ("bob",), ("Mr",), ("B",)], text.likely_person("n")) == [(True,), (False,), (False,), (False,), (False,)]
    assert one(spark, "a string, b string", [("john smith", "jon smith"), ("", ""), ("a", "")], F.round(text.indel_ratio("a", "b"), 4)) == [(0.9474,), (1.0,), (0.0,)]
    assert one(spark, "q string", [("Who killed her?",), ("who killed time",), ("what",)], text.keyword_question("q", ["killed her"], ["time"], ["kill"])) == [(True,), (False,), (False,)]
    assert text.CONSTRAINT_ORDER[0] == "<50" and one(spark, "c string", [("long",), ("?",)], text.constraint_rank("c")) == [(6,), (8,)]
    assert one(spark, "c string", [("summary of 30 words",), ("unconstrained",)], text.short_constraint("c", unconstrained="free", summary_first=True)) == [("summary",), ("free",)]
    assert one(spark, "c string", [('=1+"a"\n',), ("ok",)], text.spreadsheet_safe("c")) == [(" =1+'a'",), ("ok",)]
    assert one(spark, "c string", [("x --size 20 --input p/q",)], text.option_of("c", "size"), text.option_of("c", "count"), text.option_of("c", "input"))[0] == ("20", None, "p/q")
    assert one(spark, "c string", [("run_concat_x",), ("iterative1",), ("z",)], text.method_name("c")) == [("concat",), ("iterative",), (None,)]
    assert one(spark, "c string", [("b",)], text.filled("{a} {b}", {"a": "{b}", "b": F.col("c")}))[0][0] == "b b"
    assert one(spark, "c string", [("ANSWER: yes\nno",), ("first\nsecond",)], text.answer_after("c")) == [("yes",), ("first",)]
    assert one(spark, "n string, c string", [("Ann Lee", "Lee saw Ann"), ("Zed", "x")], text.name_in_content("n", "c")) == [(True,), (False,)]
    assert one(spark, "c string", [("a" * 60 + "MARK" + "b" * 60,), ("no",)], text.snippet("c", "MARK", 3)) == [("aaaMARKbbb",), (None,)]


# ---- statistics


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("b", 5.0), ("b", None)], "k string, v double")
    assert dict(tuple(x) for x in stats.upper_median(df, ["k"], "v").collect()) == {"a": 3.0, "b": 5.0}
    got = {x.k: x for x in df.groupBy("k").agg(stats.sem("v").alias("s0"), stats.sem("v", ddof=1).alias("s1"), *stats.metric_statistics("v")).collect()}
    assert got["a"].s0 == pytest.approx(3.5355339 / 2) and got["b"].s1 == 0 and (got["b"].n, got["b"].failures) == (2, 1)
    assert one(spark, "x string", [("44%",), ("44.4",), ("x",), (None,)], stats.percent("x")) == [(0.44,), (pytest.approx(0.444),), (None,), (None,)]
    assert one(spark, "x int", [(0,), (2500,), (2501,), (5000,), (10000,), (10001,)], stats.length_bucket("x")) == [(None,), ("0-2500",), ("2500-5000",), ("2500-5000",), ("5000-10000",), ("10000+",)]
    assert stats.fisher_exact(3, 1, 1, 3) == pytest.approx(0.48571428) and stats.fisher_exact(10, 0, 0, 10) == pytest.approx(1.0825e-5, rel=1e-3)
    assert one(spark, "m string", [("gpt-4.1-mini",)], stats.token_cost("m", F.lit(9000), F.lit(491)))[0][0] == pytest.approx(0.004386, abs=1e-6)
    with pytest.raises(Exception, match="no price"):
        one(spark, "m string", [("unknown",)], stats.token_cost("m", F.lit(1), F.lit(1)))
    assert one(spark, "m string", [("o3-mini",), ("claude",)], stats.known_provider("m"), stats.takes_temperature("m")) == [(True, False), (False, True)]
    hist = {x.bin: x.n for x in stats.histogram(df, "v", 3).collect()}
    assert hist == {0: 3, 1: 1, 2: 1}


# ---- overlap


def test_rouge_of_the_worked_example(spark):
    pairs = spark.createDataFrame([(1, "a b c d e f g h", "a b x c y d z"), (2, "", "a"), (3, "b b b", "b b")], "id int, target string, prediction string")
    got = {x.id: x for x in overlap.rouge_n(pairs, 1, keys=["id"]).collect()}
    assert round(got[1].score.precision * 100, 3) == 57.143 and round(got[1].score.recall * 100, 3) == 50.0 and round(got[1].score.f1 * 100, 3) == 53.333
    assert got[2].score.f1 == 0 and got[3].overlap == 2
    two = {x.id: x for x in overlap.rouge_n(pairs, 2, keys=["id"]).collect()}
    assert round(two[1].score.precision * 100, 3) == 16.667 and round(two[1].score.recall * 100, 3) == 14.286 and round(two[1].score.f1 * 100, 3) == 15.385
    rl = {x.id: x.s for x in pairs.select("id", overlap.rouge_l(overlap.tokens("target"), overlap.tokens("prediction")).alias("s")).collect()}
    assert rl[1].recall == 0.5 and rl[2].f1 == 0
    assert overlap.lcs_length(list("abcbdab"), list("bdcaba")) == 4 and len(overlap.lcs_members(list("abcbdab"), list("bdcaba"))) == 4
    same = spark.createDataFrame([("The cat sat. A dog ran.", "A dog ran. The cat sat.")], "a string, b string").select(overlap.rouge_lsum("a", "b").alias("s")).head().s
    assert same.f1 == 1.0
    assert one(spark, "t array<string>", [(["running", "cat", "ties"],)], overlap.stemmed("t"))[0][0] == ["run", "cat", "ti"]
    assert [stemmer.stem(w) for w in ("relational", "hopping", "generalizations", "oscillators", "sky")] == ["relat", "hop", "gener", "oscil", "sky"]


def test_continuity(spark):
    steps = spark.createDataFrame([("x", 1, "a b c"), ("x", 2, "a b d"), ("x", 3, "a b d"), ("y", 1, "q")], "item string, k int, t string")
    got = overlap.continuity(steps, "item", "k", "t").collect()
    assert [(x.item, x.pairs, x.f1) for x in got] == [("x", 2, 0.75)]


# ---- summaries


def test_folds_and_prefixes(spark):
    items = spark.createDataFrame([("x", ["A b. C d. E f.", "G h."]), ("y", [])], "item string, chunks array<string>")
    assert [x.p for x in items.select(summarize.prefixes("chunks").alias("p")).collect()] == [["A b. C d. E f.", "A b. C d. E f.\n\nG h."], []]
    assert sorted((x.item, x.summary_index, x.summary) for x in summarize.independent(items, "item", "chunks").collect()) == [("x", 1, "A b. C d."), ("x", 2, "G h.")]
    assert summarize.concatenated(items, "item", "chunks", template="Say: {text}").collect()[0].summary == "Say: A b. C d."
    assert summarize.concatenated(items, "item", "chunks", intermediate=True).count() == 2
    rows = spark.createDataFrame([("x", 2, "c"), ("x", 0, "a"), ("x", 1, "b"), ("y", 0, "z"), (None, 0, "n")], "item string, k int, t string").repartition(3)
    step = summarize.iterative("first {text}", "{previous_summary}+{text}", get("echo"))
    got = sorted((x.item, x.summary_index, x.summary) for x in summarize.fold(rows, "item", "k", "t", step).collect())
    assert got == [("x", 1, "first a"), ("x", 2, "first a+b"), ("x", 3, "first a+b+c"), ("y", 1, "first z")]
    with pytest.raises(ValueError, match="every step"):
        summarize.check_strategy("iterative", True)
    with pytest.raises(ValueError, match="unknown"):
        summarize.check_strategy("other", False)
    assert len(summarize.run_name("p", "m", "l", True)) == 6 and "lead" in PROVIDERS


# ---- entities, claims, assessments


def test_entities(spark):
    summary = spark.createDataFrame([("i", 0, "The Duke"), ("i", 1, "Jon Smith"), ("i", 2, "Nobody Here"), ("j", 0, "Duke")], "item string, ord int, entity string")
    source = spark.createDataFrame([("i", 0, "Duke's"), ("i", 1, "duke"), ("i", 2, "John Smith"), ("i", 3, "John Smyth")], "item string, ord int, entity string")
    got = sorted(tuple(x) for x in entities.hybrid_pairs(summary, source, "item").select("summary_entity", "source_entity", "how").collect())
    assert got == [("Jon Smith", "John Smith", "fuzzy"), ("The Duke", "duke", "exact")]
    told = entities.hybrid_pairs(summary, source, "item", matcher=lambda rest, src: rest.select("item", F.col("entity").alias("summary_entity"), F.when(F.col("item") == "i", "duke").otherwise("made up").alias("source_entity")))
    assert ("Nobody Here", "duke", "model") in {tuple(x) for x in told.select("summary_entity", "source_entity", "how").collect()} and told.count() == 3
    c = one(spark, "p int, a int, b int", [(2, 3, 4), (0, 0, 0)], entities.coverage("p", "a", "b"))
    assert (c[0][0].jaccard, c[0][0].recall, c[0][0].precision) == (0.4, 0.5, 2 / 3) and c[1][0].jaccard == 0
    assert one(spark, "e array<string>", [(["The Duke", "duke", "Anne"],)], entities.canonical("e"), entities.grouped("e"))[0] == (["The Duke", "Anne"], {"The Duke": "The Duke", "duke": "The Duke", "Anne": "Anne"})
    assert one(spark, "s array<string>, m array<string>", [(["a", "b", "b"], ["a"])], entities.source_only("s", "m"))[0][0] == ["b", "b"]
    names = spark.createDataFrame([("n", 0, "Martha"), ("n", 1, "Marta"), ("n", 2, "Zed"), ("m", 3, "Martha")], "novel string, k int, name string")
    assert [(x.a, x.b) for x in entities.similar_names(names, ["novel"], "name", "k").collect()] == [("Martha", "Marta")]


def test_claims(spark):
    summaries = spark.createDataFrame([("i", 1, "The cat sat. A dog flew."), ("k", 1, "")], "item string, n int, summary string")
    made = claims.extracted(summaries, ["item", "n"], "summary")
    each = claims.exploded(made, "item", "n")
    assert each.count() == 2 and claims.exploded(made, "item", "n", stop=1).count() == 1
    sources = spark.createDataFrame([("i", "the cat sat on a mat with a dog")], "item string, t string")
    told = claims.verified(each, sources, "item", "t")
    assert [x.predicted_label for x in told.orderBy("claim_index").collect()] == ["Yes", "PartialSupport"]
    score = claims.faithfulness(told, "item", "n").collect()[0]
    assert (score.claims, score.strict, score.lenient) == (2, 0.5, 1.0)
    assert claims.collection_faithfulness(claims.faithfulness(told, "item", "n")).head().strict == 50.0
    orphan = claims.verified(each.withColumn("item", F.lit("q")), sources, "item", "t")
    assert orphan.count() == 2 and claims.faithfulness(orphan, "item").head().strict == 0


def test_assessments(spark):
    good = 'CULPRIT ASSESSMENT:\n```json\n{"culprit-correct": "Yes",}\n```\nCULPRIT MINOR ERRORS: {"culprit_missing_or_wrong_alias": "No", "hallucinated_part_of_name": "No", // x\n "missing_part_of_name": "No", "included_accomplice": "N/A"}\nMAJOR ERRORS: {"different_suspect_not_accomplice": "No"}'
    df = spark.createDataFrame([(1, good), (2, "nothing")], "id int, t string").withColumn("p", assessment.parsed_assessment("t", "culprit"))
    a, b = df.orderBy("id").collect()
    assert a.p.assessment == {"culprit_correct": "Yes"} and a.p.minor_errors["included_accomplice"] == "N/A" and b.p.assessment is None
    errors = [x.e for x in df.orderBy("id").select(assessment.field_errors("p", "culprit").alias("e")).collect()]
    assert len(errors[0]) == 3 and all(e.startswith("missing") for e in errors[0]) and len(errors[1]) == 3
    flat = {x.field: x.value for x in assessment.flattened(df.where("id = 1"), "id", "culprit", "p").collect()}
    assert flat["culprit_minor_included_accomplice"] == "N/A" and flat["culprit_major_different_suspect_not_accomplice"] == "No"
    left = spark.createDataFrame([(1, "f", "Yes"), (2, "f", "N/A"), (3, "f", "No")], "id int, field string, value string")
    right = spark.createDataFrame([(1, "f", "No"), (2, "f", "No"), (4, "f", "No")], "id int, field string, value string")
    told = {x.id: (x.left_value, x.right_value, x.status) for x in assessment.compared(left, right, ["id", "field"]).collect()}
    assert told == {1: ("Yes", "No", "different"), 2: ("N/A", "No", "same"), 3: ("No", "MISSING", "left_only"), 4: ("MISSING", "No", "right_only")}
    assert assessment.agreement(assessment.compared(left, right, ["id", "field"]), "field").head().agreement == 0.5
    acc = assessment.accuracy(spark.createDataFrame([("r", "Yes", "No"), ("r", "Yes", "Yes"), ("r", None, "Yes")], "run string, culprit string, accomplice string"), "run").head()
    assert (acc.n, acc.culprit_accuracy, acc.both_accuracy) == (2, 1.0, 0.5)
    assert one(spark, "a string, b string", [("x", ""), ("x", "y")], assessment.culprit_of("a", "b", "last"), assessment.culprit_of("a", "b", "1")) == [("x", "x"), ("y", "x")]
    truth = spark.createDataFrame([("s", "N/A", "Ann")], "story_id string, culprits string, suspects string")
    got = {x.item: (x.culprits, x.suspects) for x in assessment.ground_truth(spark.createDataFrame([("s",), ("t",)], "item string"), truth, "item").collect()}
    assert got == {"s": ("None", "Ann"), "t": ("None", "None")}
    assert one(spark, "o map<string,string>, a string", [({"A": "A - Bob"}, "A"), ({"A": "x"}, "B")], assessment.option_text("o", "a")) == [("Bob",), (None,)]


# ---- analysis


def test_analysis(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("a", 3, 3.0), ("b", 1, 1.0)], "item string, pos int, v double")
    assert [(x.diff_position, x["diff"]) for x in analysis.differences(rows, "item", "pos", "v").orderBy("diff_position").collect()] == [(1, 2.0), (2, -1.0)]
    assert [(x.item, x.first, x.last) for x in analysis.first_and_last(rows, "item", "pos", "v").collect()] == [("a", 2.0, 3.0)]
    assert analysis.sampled(rows, "pos", 2, 7).collect() == analysis.sampled(rows.repartition(3), "pos", 2, 7).collect()
    assert [tuple(x) for x in analysis.frequencies(rows, "item").collect()] == [("a", 3), ("b", 1)]
    side = {x.item: x.side for x in analysis.outer_compared(rows.where("pos = 1"), rows.where("pos = 2"), "item", "v").collect()}
    assert side == {"a": "both", "b": "left_only"}
    assert [tuple(x) for x in analysis.statuses(spark.createDataFrame([("failed",), ("skipped",), ("failed",)], "status string")).collect()] == [(0, 2, 1)]
    assert one(spark, "a array<int>, b array<int>", [([1, 2], [2, 1]), ([1], [2])], analysis.set_agreement("a", "b")) == [(True,), (False,)]
    line = analysis.line_numbers(spark.createDataFrame([("d", "[1] a\nb\n[4] c\n[5] d")], "i string, t string"), "i", "t").head()
    assert (line.lines, line.numbered, line.first_number, line.gaps, line.misplaced) == (4, 3, 1, 1, 2)
    items = spark.createDataFrame([("i", ["a b", "c"], True)], "item string, chunks array<string>, told boolean")
    assert [analysis.item_word_counts(items, "item", "chunks", drop_last=d).head().words for d in ("never", "always", "told")] == [3, 2, 2]
    spread = analysis.name_spread(spark.createDataFrame([("n1", "a", "x"), ("n2", "b", "x"), ("n1", "a", "y")], "novel string, item string, name string"), "novel", "item", "name")
    assert [tuple(x) for x in spread.collect()] == [("x", 2, 2), ("y", 1, 1)]


# ---- storage


def test_collections(spark, tmp_path):
    root = tmp_path / "sets"
    items = root / "bmds_x" / "items"
    items.mkdir(parents=True)
    (root / "empty").mkdir()
    (root / "bmds_x" / "collection.json").write_text(json.dumps({"domain": "d", "items": ["B two", "A"], "num_items": 2}))
    for name in ("A", "B two"):
        doc = {"content": f"text {name}", "doc_id": name, "chunks": ["c1", "c2"], "metadata": {"detection": {"reveal_segment": "told"}}}
        (items / f"{name}.json").write_text(json.dumps({"item_metadata": {"item_id": name}, "documents": [doc]}, indent=1))
    path = str(root / "bmds_x")
    assert collections.list_datasets(spark, str(root)) == ["bmds_x"]
    ordered = collections.items(spark, path, in_collection_order=True).orderBy("position")
    assert [x.item_id for x in ordered.collect()] == ["B two", "A"]
    docs = collections.documents(collections.items(spark, path))
    told = docs.select("item_id", collections.source_text("content", collections.reveal("bmds"), add_reveal=True).alias("t"))
    assert {x.t for x in told.collect()} == {"text A\n\ntold", "text B two\n\ntold"}
    assert collections.input_type(collections.items(spark, path)) == "chunks"
    assert collections.load_item(spark, path, "A").select(collections.segments()).head()[0] == ["c1", "c2"]
    for bad in (lambda: collections.load_item(spark, path, "Z"), lambda: collections.collection(spark, str(root / "empty")), lambda: collections.reveal("other"), lambda: collections.read_json(spark, f"{path}/no.json", "a int")):
        with pytest.raises(collections.CollectionError):
            bad()
    with pytest.raises(ValueError, match="exclude"):
        collections.source_text("content", F.lit("x"), add_reveal=True, reveal_only=True)
    (items / "bad.json").write_text("{")
    assert [x.item_id for x in collections.items(spark, path).where("_corrupt_record is not null").collect()] == ["bad"]
    for k in (2, 10, 1):
        d = tmp_path / "claims" / "items" / "A"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{k}.json").write_text(json.dumps({"claims": [f"c{k}"]}))
    got = collections.claim_files(spark, str(tmp_path / "claims")).orderBy("summary_index").collect()
    assert [(x.item_id, x.summary_index) for x in got] == [("A", 1), ("A", 2), ("A", 10)]
    last = collections.evaluation_files(spark, str(tmp_path / "claims"), "claims array<string>", by_range=True, last_only=True).collect()
    assert [(x.range_num, x.claims) for x in last] == [(10, ["c10"])]
    assert collections.matching(["a_x", "b_x"], "a*") == ["a_x"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "user.txt").write_text("Hi {x}\nyou")
    (tmp_path / "p" / "12-A title.txt").write_text("novel")
    assert collections.prompts(spark, str(tmp_path / "p"))["user"] == "Hi {x}\nyou"
    assert [(x.novel_id, x.title, x.text) for x in collections.novels(spark, str(tmp_path / "p")).collect()] == [(12, "A title", "novel")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "bad")], "item string, n int, error string")
    at = str(tmp_path / "t")
    assert sinks.append_new(df, at, ["item"]) == 2 and sinks.append_new(df, at, ["item"]) == 0
    sinks.results_and_errors(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "results")).count() == spark.read.parquet(str(tmp_path / "r" / "errors")).count() == 1
    sinks.export_csv(spark.createDataFrame([("=x", 1)], "s string, n int"), str(tmp_path / "c"))
    assert spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(str(tmp_path / "c")).head().n == "1"
    sinks.export_collection(spark, df.select("item"), {"domain": "é"}, str(tmp_path / "col"))
    assert json.loads((tmp_path / "col" / "collection.json").read_text())["num_items"] == 2
    sinks.export_json(df, str(tmp_path / "j"), "item")
    assert sorted(x for x in os.listdir(tmp_path / "j") if x[0] != "_" and x[0] != ".") == ["item=a", "item=b"]
    assert sinks.run_id("s", "k", {"b": 1, "a": 2}) == sinks.run_id("s", "k", {"a": 2, "b": 1})
    sinks.save_table(df, str(tmp_path / "tab"), partition_by=["item"])
    usage = spark.createDataFrame([("t", "m", 1, 2, 3, 0.1, 0.2, 0.3)], "ts string, model string, input_tokens long, output_tokens long, total_tokens long, input_cost double, output_cost double, total_cost double")
    sinks.log_usage(usage, str(tmp_path / "log"))
    (tmp_path / "log" / "more.csv").write_text("\nshort,row\nt,m,1,2,3,0.1,0.2,oops\nt,m,1,2,3,0.1,0.2,0.5\n")
    assert collections.spending(spark, str(tmp_path / "log")).agg(F.sum("total_cost")).head()[0] == pytest.approx(0.8)
    assert summarize.usage_rollup(usage, "model").head().total_tokens == 3


# ---- streaming


def _drain(query):
    query.processAllAvailable()
    query.stop()


def test_streamed_fold_waits_for_order(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    stream = spark.readStream.schema("item string, k long, t string").json(str(src))
    made = fold.summaries(stream, "item", "k", "t", lambda before, chunk: (before or "") + chunk)
    query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()
    for n, rows in enumerate([[("x", 1, "b"), ("y", 0, "q")], [("x", 0, "a")], [("x", 1, "B"), ("x", 2, "c")]]):
        (src / f"tmp{n}").write_text("\n".join(json.dumps(dict(zip(("item", "k", "t"), r, strict=True))) for r in rows))
        os.rename(src / f"tmp{n}", src / f"f{n}.json")
        query.processAllAvailable()
    query.stop()
    got = sorted((x.item, x.summary_index, x.summary) for x in spark.read.parquet(out).collect())
    assert got == [("x", 1, "a"), ("x", 2, "ab"), ("x", 3, "abc"), ("y", 1, "q")]


def test_streamed_continuity_totals_and_appends(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"item": "x", "k": k, "t": t}) for k, t in enumerate(["a b c", "a b d"])))
    stream = spark.readStream.schema("item string, k long, t string").json(str(src))
    _drain(fold.continuity(stream, "item", "k", "t").writeStream.format("memory").queryName("cont").start())
    assert [(x.step, x.overlap, x.f1) for x in spark.table("cont").collect()] == [(1, 1, 0.5)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "l.csv").write_text("t,m,1,2,3,0.1,0.2,0.3\n\nt,m,1,2,3,0.1,0.2,oops\nt,m,1,2,3,0.1,0.2,0.5\n")
    _drain(fold.spending_stream(spark, str(tmp_path / "log")).writeStream.format("memory").queryName("spent").outputMode("complete").start())
    assert [(x.model, x.calls) for x in spark.table("spent").collect()] == [("m", 2)]
    for n in range(2):
        fold.append_once(stream, str(tmp_path / "tab"), ["item", "k"], str(tmp_path / f"cp{n}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "tab")).count() == 2


def test_windows_over_events(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = fold.windowed(events, "ts", "event_type", length="1 day")
    assert got.agg(F.sum("n")).head()[0] == events.count()


# ---- queries


def test_every_query_runs_and_has_a_stable_schema(spark):
    from lumenfold.plans.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 50
    for name, f in QUERIES.items():
        df = f(spark, "/root/testdata/sf0.001")
        assert df.schema == f(spark, "/root/testdata/sf0.001").schema and (df.count() > 0 or name == "containment_semi"), name


def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from lumenfold.plans.queries import ORACLES, QUERIES

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    for name, sql in ORACLES.items():
        df, told = QUERIES[name](spark, sf), con.execute(sql)
        names = sorted(x[0] for x in told.description)
        assert names == sorted(df.columns), name
        order = [[x[0] for x in told.description].index(n) for n in names]
        want = sorted(str(tuple(r[k] for k in order)) for r in told.fetchall())
        assert sorted(str(tuple(r[n] for n in names)) for r in df.collect()) == want, name
