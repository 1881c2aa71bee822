"""Whole runs, ingestion, SQL functions and settings."""

import pytest
from pyspark.sql import functions as F

from lumenfold import config
from lumenfold.functions import sql, text
from lumenfold.operators import ingest
from lumenfold.plans import runs
from lumenfold.providers import get


def test_runs_go_on_where_they_were(spark, tmp_path):
    out = str(tmp_path)
    content = {"a": "Ann Lee met Bob Roy. They talked.\nBob Roy left. Ann Lee cried.\nThe end came.", "b": "One line.\nTwo lines."}
    items = spark.createDataFrame(list(content.items()), "item_id string, content string")
    name, chunked = runs.chunk_run(items.where("item_id = 'a'"), out, "bmds", "fixed_count", 2)
    again, chunked = runs.chunk_run(items, out, "bmds", "fixed_count", 2)
    assert name == again and name.startswith("bmds_chunks_") and {x.item_id: len(x.chunks) for x in chunked.collect()} == {"a": 2, "b": 2}
    for strategy, want in (("no_op", 2), ("independent", 4), ("concat", 4), ("iterative", 4)):
        _, made = runs.summarize_run(chunked, out, "bmds", strategy, provider=get("echo"))
        assert made.count() == want, strategy
    _, s = runs.summarize_run(chunked, out, "bmds", "concat", provider=get("echo"))
    _, scored = runs.overlap_run(s, items, out, "bmds", spec="last")
    assert {x.item_id: x.score.recall for x in scored.collect()} == {"a": 1.0, "b": 1.0}
    _, multi = runs.overlap_multi_run(s, items, out, "bmds", most=1)
    assert sorted((x.item_id, x.range_num) for x in multi.collect()) == [("a", 1), ("b", 1)]
    assert runs.continuity_run(s, out, "bmds")[1].count() == 2 and runs.continuity_run(s, out, "bmds", all_but_last=True)[1].count() == 0
    _, covered = runs.entity_run(s, items, out, "bmds")
    assert {x.item_id: x.coverage.recall for x in covered.collect()}["a"] == 1.0
    _, extracted = runs.claims_run(s, out, "bmds")
    _, faithful = runs.faithfulness_run(extracted, items, out, "bmds", last_only=True, claim_stop=2)
    assert {(x.item_id, x.claims, x.strict) for x in faithful.collect()} == {("a", 2, 1.0), ("b", 2, 1.0)}
    segments = chunked.select("item_id", F.col("chunks").alias("segments"))
    solver = lambda prompts: [f"<Main Culprit(s)>Bob</MAIN CULPRIT(S)> {len(p)}" for p in prompts]
    _, solved = runs.solve_run(segments, out, "bmds", spec="all-but-last", solver=solver)
    judge = lambda prompts: ['CULPRIT ASSESSMENT: {"culprit_correct": "' + ("Yes" if p == "Bob / Bob" else "No") + '"}' for p in prompts]
    truth = spark.createDataFrame([("a", "Bob")], "story_id string, culprits string")
    _, judged = runs.score_run(solved, truth, out, "bmds", judge=judge)
    assert {x.item_id: x.culprit.assessment["culprit_correct"] for x in judged.collect()} == {"a": "Yes", "b": "No"}


def test_claims_without_words_are_held_as_they_stand(spark, tmp_path):
    """Claims of a last turn that have no ASCII letter or digit, as ``Ñ.`` has none, are in the text that they are from."""
    sources = spark.createDataFrame([("a", "El oso. Ñ.\n... Ça va"), ("b", "Ann left. Ñ")], "item_id string, content string")
    extracted = spark.createDataFrame([("a", 1, ["El oso", "Ñ.", "..."]), ("b", 1, ["Ann left", "Ü", "Ñ"]), ("c", 1, ["Ñ"])], "item_id string, summary_index int, claims array<string>")
    for method in ("full_text", "bm25"):
        _, told = runs.faithfulness_run(extracted, sources, str(tmp_path), "tales", method=method)
        assert {x.item_id: (x.claims, x.faithful) for x in told.collect()} == {"a": (3, 3), "b": (3, 2), "c": (0, 0)}
    _, told = runs.faithfulness_run(extracted, sources, str(tmp_path), "tales", literal=False)
    assert {x.item_id: x.faithful for x in told.collect()} == {"a": 1, "b": 1, "c": 0}


def test_ingested_novels_and_passages(spark):
    novels = spark.createDataFrame([(1, "T", "\n".join(f"[{k}] line {k} Zed" for k in range(1, 11))), (2, "U", "[1] x\n[2] y"), (3, "V", "q")], "novel_id int, title string, text string")
    q = "array<struct<question:string,answer:string,answer_position:int,options:map<string,string>>>"
    rows = [(1, 5, 1, [("Who killed early?", "A", 2, {"A": "x"}), ("Who killed him?", "B", 9, {"A": " y ", "B": "z"})]), (1, 2, 1, [("Who killed her?", "A", 10, {"A": "k"}), ("Weather?", "A", 10, {})]), (2, 1, 1, [("Who killed?", "A", 1, {})]), (3, 1, 1, [("Who killed?", "A", 1, {})])]
    annotations = spark.createDataFrame(rows, f"novel_id int, time_cost int, num_paragraphs int, questions {q}")
    got = ingest.novel_items(novels, annotations, lambda c: text.keyword_question(c, [], [], ["killed"]), exclude=(3,), answer_map={"y": "mapped"}, names={"Zed": "Ann"}).collect()
    assert len(got) == 1 and [x.question for x in got[0].questions] == ["Who killed her?", "Who killed him?"] and got[0].questions[1].options["A"] == "mapped"
    assert got[0].content.split("\n")[-1] == "line 9 Ann" and got[0].reveal == "line 10 Ann"
    assert ingest.near_duplicates(ingest.questions(annotations)).select("novel_id").distinct().collect()[0].novel_id == 1
    passages = spark.createDataFrame([("a b c", ("7", "u", "l"), [("q?", 1, [("w", "x", "r")])], "train")], "document string, metadata struct<passage_id:string,uid:string,license:string>, questions array<struct<question_text:string,question_number:int,responses:array<struct<worker_id:string,uid:string,response_text:string>>>>, split string")
    item = ingest.passage_items(passages, spark.createDataFrame([(7, "Title", None)], "passage_id int, title string, author string")).head()
    assert (item.item_id, item.metadata.title, item.metadata.author, item.metadata.document_length_words, item.metadata.num_questions) == ("7", "Title", "", 3, 1)


def test_sql_functions(spark):
    sql.register(spark)
    assert [tuple(x) for x in spark.sql(r"select * from chunk_text('ab\nc\nd', 4, '\n')").collect()] == [(0, "ab\nc"), (1, "d")]
    assert tuple(spark.sql("select word_count(' a  b '), bare_tokens('A-b'), share_percent('44%')").head()) == (2, ["a", "b"], 0.44)


def test_settings(monkeypatch):
    monkeypatch.setenv("LUMENFOLD_DEFAULT_CHUNK_SIZE", "50")
    assert config.Config.from_env().default_chunk_size == 50
    config.Config().validate()
    for bad in ({"default_num_chunks": 0}, {"default_chunk_size": -1}, {"log_level": "LOUD"}):
        with pytest.raises(config.ConfigError):
            config.Config(**bad).validate()
    monkeypatch.setenv("LUMENFOLD_DEFAULT_CHUNK_SIZE", "x")
    with pytest.raises(config.ConfigError):
        config.Config.from_env()


def test_small_helpers(spark):
    from lumenfold.operators import analysis, entities
    from lumenfold.sources import collections

    doc = "struct<content:string,doc_id:string,chunks:array<string>,summaries:array<string>,metadata:string>"
    items = spark.createDataFrame([("a", [("t", "1", ["c"], ["s"], None)]), ("b", []), ("c", [("", "1", None, ["s"], None)]), ("d", [("t", "1", None, None, None)])], f"item_id string, documents array<{doc}>")
    good, bad = collections.complete(items)
    assert [x.item_id for x in good.collect()] == ["a"] and {x.item_id: x.lacks for x in bad.collect()} == {"b": "documents", "c": "content", "d": "summaries"}
    assert items.where("item_id = 'a'").select(collections.chunks_of(0)).head()[0] == ["c"]
    with pytest.raises(Exception, match="no document 3"):
        items.select(collections.chunks_of(3)).collect()
    assert spark.createDataFrame([({"a": 1, "b": 2},)], "m map<string,int>").select(collections.without_keys("m", "a")).head()[0] == {"b": 2}
    rows = spark.createDataFrame([("x", k) for k in range(5)], "g string, v int")
    assert [x.band for x in analysis.bands(rows, [F.col("v")], 2, "g").orderBy("v").collect()] == [0, 0, 1, 1, 2]
    named = spark.createDataFrame([("Ann met Bob. Ann left.",), (None,)], "t string")
    assert [x[0] for x in named.select(entities.recognised_in_windows("t", 13)).collect()] == [["Ann", "Bob"], None]
