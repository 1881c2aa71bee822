"""BM25 searches against scoring every passage."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from lumenfold.operators import claims, retrieval
from lumenfold.operators.overlap import plain_tokens
from lumenfold.sources.scratch import folder


def plain(passages, queries, top):
    """passages: (scope, id, text), queries: (scope, id, text)."""
    words = {}
    for s, p, t in passages:
        if p is not None:
            words.setdefault(s, {}).setdefault(p, []).extend(plain_tokens(t or ""))
    asked = {}
    for s, q, t in queries:
        if q is not None:
            asked.setdefault((s, q), set()).update(plain_tokens(t or ""))
    out = []
    for (s, q), terms in asked.items():
        own = words.get(s, {})
        lengths = [len(w) for w in own.values() if w]
        df = Counter(t for w in own.values() for t in set(w))
        scored = []
        for p, w in own.items():
            tf = Counter(w)
            hit = [t for t in terms if tf[t]]
            if hit:
                score = math.fsum(math.log(1 + (len(own) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(w) / (sum(lengths) / len(lengths)))) for t in hit)
                scored.append((-math.floor(score * 1e6 + 0.5) / 1e6, p))
        out += [(s, q, k + 1, p, round(-x, 6)) for k, (x, p) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def rounded(rows):
    return sorted((*x[:-1], round(x[-1], 6)) for x in map(tuple, rows))


@pytest.mark.parametrize(("block", "seeds", "share"), [(64, 400, 0.6), (2, 3, 1.0), (5, 30, 0.0)])
def test_best_are_those_of_all_pairs(spark, monkeypatch, block, seeds, share):
    monkeypatch.setattr(retrieval, "SEEDS", seeds)
    monkeypatch.setattr(retrieval, "SHARE", share)
    rng = random.Random(block)
    text = lambda n: " ".join(f"W{min(int(rng.paretovariate(0.7)), 200)}" for _ in range(n))
    passages = [(rng.choice("ab"), k, text(rng.randrange(0, 40))) for k in range(300)]
    passages += [("a", 400 + k, "w1 w2 w3 w3") for k in range(60)] + [("a", 1, "w5 twice"), ("b", None, "w1"), ("b", 900, None), ("b", 901, "...")]
    queries = [(rng.choice("ab"), k, text(rng.randrange(0, 25))) for k in range(40)] + [("a", 100, "w1"), ("b", 101, "unseen"), ("c", 102, "w1"), ("a", None, "w1"), ("a", 103, None), ("a", 100, "W2 w3")]
    made = spark.createDataFrame(passages, "s string, p int, t string").repartition(3)
    asked = spark.createDataFrame(queries, "s string, q int, t string")
    index = retrieval.build(made, folder(spark, "test"), passage_id="p", text="t", scope=("s",), block=block)
    assert rounded(retrieval.search(index, asked, query_id="q", text="t", top=4).collect()) == plain(passages, queries, 4)
    # no scope: all passages compete
    path = folder(spark, "test")
    retrieval.build(made.where("s = 'a'"), path, passage_id="p", text="t", block=block)
    got = retrieval.search(retrieval.Index.read(spark, path), asked.where("s = 'a'"), query_id="q", text="t", top=4).collect()
    assert rounded(got) == [x[1:] for x in plain([x for x in passages if x[0] == "a"], [x for x in queries if x[0] == "a"], 4)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "p int, t string")
    index = retrieval.build(none, folder(spark, "test"), passage_id="p", text="t")
    assert retrieval.search(index, none, query_id="p", text="t").count() == 0


def test_few_pairs_are_finished(spark):
    sf = "/root/testdata/sf0.01"
    passages = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("conv_id * 1000 + turn as p", "text")
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    index = retrieval.build(passages, folder(spark, "test"), passage_id="p", text="text")
    told = retrieval.stages(index, queries, query_id="item_id", text="text", top=3)
    words = {x.p: set(plain_tokens(x.text or "")) for x in passages.collect()}
    all_pairs = sum(bool(w & set(plain_tokens(q.text))) for q in queries.collect() for w in words.values())
    assert told["best"].count() == 3 * queries.count()
    assert told["finished"].count() < 0.1 * all_pairs and told["started"].count() < 0.6 * all_pairs


def test_claims_are_verified_by_what_is_retrieved(spark):
    far = "the butler took the silver spoon " + "and nothing else happened for days " * 30 + "the maid hid the golden key"
    sources = spark.createDataFrame([("i", far), ("k", ""), ("n", None)], "item string, t string")
    rows = [("i", 0, "The butler took the spoon"), ("i", 1, "the maid took the golden spoon"), ("i", 2, ""), ("i", 3, None), ("k", 0, "anything"), ("none", 0, "anything"), ("n", 0, "x")]
    each = spark.createDataFrame(rows, "item string, claim_index int, claim string")
    label = lambda **how: {(x.item, x.claim_index): x.predicted_label for x in claims.verified(each, sources, "item", "t", **how).collect()}
    whole, found = label(), label(method="bm25", top=1, words=8)
    assert whole[("i", 1)] == "Yes" and whole[("none", 0)] is None and whole[("n", 0)] is None
    # the two halves of the second claim stand in different passages
    assert found[("i", 0)] == "Yes" and found[("i", 1)] == "PartialSupport" and found[("i", 2)] == "No" and found[("k", 0)] == "No" and found[("none", 0)] is None
    with pytest.raises(ValueError, match="no method"):
        claims.verified(each, sources, "item", "t", method="x")
