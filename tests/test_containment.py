"""Containment by anchors against looking for every term in every text."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.operators import containment, experiments


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 59), st.integers(1, 60))
def test_a_text_has_the_anchors_of_all_it_holds(data, at, n):
    term = data[at : at + n]
    if term:
        level = len(term).bit_length() - 1
        own = containment.anchors(np.frombuffer(term[: 1 << level], dtype=np.uint8), level)
        assert len(own) == 1 and own[0] in containment.anchors(np.frombuffer(data, dtype=np.uint8), level)


@pytest.mark.parametrize("together", [1, 1000])
def test_pairs_are_those_of_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(containment, "TOGETHER", together)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [word(rng.randrange(0, 90)) for _ in range(60)] + [word(40)] * 3 + ["", None, "a" * 500]
    terms = [word(rng.randrange(0, 7)) for _ in range(40)] + [t[a : a + n] for t in texts[:60] for a, n in [(rng.randrange(0, 40), rng.randrange(8, 50))]] + ["a" * 400, "a" * 501, None, ""]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "k int, text string, s string").repartition(3)
    others = spark.createDataFrame([(t,) for t in terms], "o string")
    got = {(x.k, x.term) for x in containment.keyed(rows, "text", "t1", "t2").join(containment.pairs(rows, others, "text", "o"), ["t1", "t2"]).select("k", "term").collect()}
    want = {(k, o) for k, t in enumerate(texts) for o in terms if t is not None and o and o in t}
    assert got == want
    held = {x.k for x in containment.contained_in(rows, others, "text", "o").collect()}
    assert held == {k for k, _ in want}
    assert {x.k for x in containment.contained_in(rows, others, "text", "o", anti=True).collect()} == set(range(len(texts))) - held
    either = held | {k for k, t in enumerate(texts) if t and any(o and t in o for o in terms)}
    assert {x.k for x in containment.contained_in(rows, others, "text", "o", either_way=True).collect()} == either
    assert containment.contained_in(rows, others, "text", "o").columns == rows.columns
    assert containment.contained_in(rows, others.limit(0), "text", "o").count() == 0 and containment.contained_in(rows.limit(0), others, "text", "o").count() == 0


def test_few_candidates_are_sent(spark):
    """Texts send hashes, some 2 bytes for each byte of text and size of terms, and only true pairs meet."""
    texts = spark.range(200).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.md5((F.col("id") * 1000 + i).cast("string").cast("binary"))), " ").alias("text"))
    terms = texts.select(F.substring("text", 500, 200).alias("o"))
    own = containment.keyed(texts, "text", "t1", "t2").withColumn("s", F.lit(0).cast("long"))
    of = containment.keyed(terms.withColumnRenamed("o", "term"), "term", "o1", "o2").withColumn("s", F.lit(0).cast("long"))
    assert containment.candidates(own, of).count() == 200
    sent = own.select("t1", "t2", "text", "s").mapInArrow(containment._of_texts([7]), "t1 long, t2 long, s long, anchor long").count()
    assert sent * 32 < 2 * texts.select(F.sum(F.octet_length("text"))).first()[0]


def test_scopes_and_differences(spark):
    one = spark.createDataFrame([("i", "Holmes", "Sherlock Holmes"), ("i", "Watson", "John"), ("k", "Holmes", "X"), ("k", "Anna", "anna b")], "item string, summary_entity string, source_entity string")
    two = spark.createDataFrame([("i", "Mr Holmes", "Y"), ("k", "Wat", "W"), ("i", "Q", None)], "item string, summary_entity string, source_entity string")
    told = {(x.item, x.summary_entity, x.side): x.reasonable for x in experiments.difference_quality(one, two, "item").collect()}
    assert told == {("i", "Holmes", "missing"): True, ("i", "Watson", "missing"): False, ("k", "Holmes", "missing"): False, ("k", "Anna", "missing"): False, ("i", "Mr Holmes", "extra"): True, ("k", "Wat", "extra"): True}
    back = {(x.item, x.summary_entity): x.reasonable for x in experiments.difference_quality(two, one, "item").where("side = 'extra'").collect()}
    assert back[("k", "Anna")] and not back[("i", "Watson")]
