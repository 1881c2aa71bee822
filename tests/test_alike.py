"""Similarity joins and common subsequences against comparing all."""

from __future__ import annotations

import difflib
import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.functions.text import indel_ratio, normalize_entity
from lumenfold.operators import alike, entities, ingest, matching, overlap
from lumenfold.plans import more, queries

SF = "/root/testdata/sf0.001"


def table(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        before, row = rows[-1], [0]
        for j, y in enumerate(b, 1):
            row.append(before[j - 1] + 1 if x == y else max(before[j], row[-1]))
        rows.append(row)
    return rows


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=30), st.text("abc", max_size=30))
def test_subsequences_are_those_of_the_whole_table(a, b):
    rows = table(a, b)
    assert overlap.lcs_length(a, b) == rows[-1][-1]
    kept, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            kept.add(i - 1)
            i, j = i - 1, j - 1
        elif rows[i - 1][j] > rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    assert overlap.lcs_members(a, b) == kept


def test_long_texts_take_little_memory():
    rng = random.Random(1)
    a, b = ([f"w{rng.randrange(500)}" for _ in range(20_000)] for _ in range(2))
    tracemalloc.start()
    kept = overlap.lcs_members(a, b)
    assert len(kept) == overlap.lcs_length(a, b) and tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()


def ratio(a, b):
    return 2 * table(a, b)[-1][-1] / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize(("similar", "two"), [(0.8, 40), (0.6, 40), (0.8, 8), (1.0, 5)])
def test_pairs_are_those_of_all_pairs(spark, monkeypatch, similar, two):
    monkeypatch.setattr(alike, "TWO", two)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("aabcdé ") for _ in range(n))
    base = [word(rng.randrange(0, 14)) for _ in range(40)] + [word(60) for _ in range(3)]
    near = ["".join(c for c in x if rng.random() > 0.1) for x in base]
    left = [(rng.choice("ik"), x) for x in base + base[:5]] + [("i", None), (None, "abc"), ("k", ""), ("i", "z" * 50)]
    right = [(rng.choice("ik"), x) for x in near + base[:10]] + [("i", ""), ("k", ""), ("i", "z" * 44), ("k", None)]
    made = [spark.createDataFrame(x, f"item string, {name} string") for x, name in ((left, "p"), (right, "q"))]
    got = {(x.item, x.a, x.b): x.ratio for x in alike.pairs(made[0], made[1], by=["item"], a="p", b="q", similar=similar).collect()}
    want = {(i, a, b): ratio(a, b) for i, a in left for k, b in right if i == k and a is not None and b is not None and ratio(a, b) >= similar}
    assert got == pytest.approx(want)
    assert len(want) > 5
    assert alike.pairs(made[0].limit(0), made[1], by=["item"], a="p", b="q", similar=similar).count() == 0


def test_ten_thousand_names_of_an_item(spark):
    """Names of an item and slips of the pen in them: of 100 million pairs few meet."""
    rng = random.Random(7)
    parts = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(3)) for _ in range(2000)]
    names = sorted({f"{rng.choice(parts)} {rng.choice(parts)}" for _ in range(10_200)})[:10_000]
    slips = [x[:k] + x[k + 1 :] for x in names[::20] for k in [rng.randrange(len(x))]]
    source = spark.createDataFrame([("i", k, x) for k, x in enumerate(names)], "item string, ord int, entity string").repartition(8)
    summary = spark.createDataFrame([("i", k, x) for k, x in enumerate(slips)], "item string, ord int, entity string")
    found = {x.summary_entity: (x.source_entity, x.ratio) for x in entities.fuzzy_pairs(summary, source, "item").collect()}
    assert len(found) == len(set(slips))
    for slip in slips[:40]:
        best = max(((2 * overlap.lcs_length(slip, x) / (len(slip) + len(x)), -k) for k, x in enumerate(names)))
        assert found[slip] == (names[-best[1]], best[0])


def test_fuzzy_queries_are_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", entities.recognised("text").alias("e"))
    norm = {x.e: x.n for x in rows.select(F.explode("e").alias("e")).distinct().select("e", normalize_entity("e").alias("n")).collect()}
    turns: dict = {}
    for x in rows.collect():
        turns.setdefault(x.conv_id, []).append((x.turn, x.e or []))
    best, kinds = {}, {}
    for conv, some in turns.items():
        last = max(t for t, _ in some)
        source = [(t, k, e) for t, es in some if t != last for k, e in enumerate(es)]
        for e in (e for t, es in some if t == last for e in es):
            near = sorted((-ratio(norm[e], norm[o]), t, k, o) for t, k, o in source if ratio(norm[e], norm[o]) >= 0.8)
            how = "exact" if any(norm[o] == norm[e] for *_, o in source) else "fuzzy" if near else None
            if near:
                best[conv, e] = (near[0][3], int(-near[0][0] * 1e6 + 0.5))
            if how:
                kinds[conv, how] = kinds.get((conv, how), 0) + 1
    got = {(x.conv_id, x.summary_entity): (x.source_entity, x.ratio) for x in queries.entity_fuzzy_best(spark, SF).collect()}
    assert got == best and len(best) > 5
    assert {(x.conv_id, x.how): x.n for x in more.entity_hybrid(spark, SF).collect()} == kinds


def brute_links(rows, similar):
    """Per row: the first row of its name, and how many rows it is alike, the earlier one first."""
    ratios, out = {}, {}
    for block, k, x in rows:
        if block is None or x is None:
            out[k] = (None, 0)
            continue
        same = [(j, y) for b, j, y in rows if b == block and y is not None]
        for j, y in same:
            pair = (x, y) if k < j else (y, x)
            if pair not in ratios:
                ratios[pair] = difflib.SequenceMatcher(None, *pair).ratio() >= similar
        out[k] = (min(j for j, y in same if y == x), sum(ratios[(x, y) if k < j else (y, x)] for j, y in same if j != k))
    return out


def page_names(spark):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return spark.read.parquet(f"{SF}/pages.parquet").select(host.alias("host"), "page_id", F.substring_index("url", "/", -1).alias("name"))


def test_similar_names_are_brute_force(spark):
    rows = page_names(spark).collect()
    want = set()
    for x in rows:
        for y in rows:
            if x.host == y.host and x.page_id < y.page_id:
                r = difflib.SequenceMatcher(None, x.name, y.name).ratio()
                if r >= 0.7:
                    want.add((x.host, x.page_id, y.page_id, int(r * 1e6 + 0.5)))
    pairs = entities.similar_names(page_names(spark), ["host"], "name", "page_id")
    assert {tuple(x) for x in pairs.select("host", "i", "j", F.floor(F.col("ratio") * 1e6 + 0.5)).collect()} == want and want


def test_similar_questions_count_all_pairs(spark):
    want = brute_links([tuple(x) for x in page_names(spark).collect()], 0.7)
    got = more.similar_questions(spark, SF).collect()
    assert len(got) == len(want) and {x.page_id: (x.class_id, x.links) for x in got} == want and any(n for _, n in want.values())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=40), st.text("abcd", min_size=1, max_size=40)), min_size=1, max_size=20), st.sampled_from([0.3, 0.5, 0.7, 0.9, 1.0]))
def test_blocks_are_those_of_the_library(pairs, similar):
    least = matching.least_common(80, similar)
    names = matching._Names([x for p in pairs for x in p])
    one, two = np.arange(0, 2 * len(pairs), 2), np.arange(1, 2 * len(pairs), 2)
    got = names.alike(one, two, least[[len(a) + len(b) for a, b in pairs]], similar)
    assert got.tolist() == [difflib.SequenceMatcher(None, a, b).ratio() >= similar for a, b in pairs]


@pytest.mark.parametrize(("similar", "part", "at_once"), [(0.7, 4096, 1 << 20), (0.7, 40, 500), (0.5, 60, 90), (0.9, 25, 1 << 20), (1.0, 30, 40)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, similar, part, at_once):
    """Names of every kind: endings longer than stems, one character short, copies on both sides of others, alike in one order only, long ones, none."""
    monkeypatch.setattr(matching, "PART", part)
    monkeypatch.setattr(matching, "AT_ONCE", at_once)
    monkeypatch.setattr(matching, "BLOCKS_OF", 64)
    rng = random.Random(5)
    word = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    ends = ["?utm_source=feed", "?page=2&ref=x", "#top", ".html", "", "/ab/ab/ab", "é日本語の終わり"]
    names = [word("0123456789", rng.choice([5, 6, 7])) + rng.choice(ends) for _ in range(110)]
    names += [word("aab", rng.randrange(0, 12)) + rng.choice(["", "-ba-ba", "?aaab"]) for _ in range(50)] + [word("ab ", rng.choice([60, 64, 65, 70])) for _ in range(8)]
    names += [x + word("abcé", 2) for x in [word("abcdefgh", 210)] * 2] + ["tide", "diet", "tide", "diet"] * 3 + ["", "", None] + rng.sample(names, 20)
    rng.shuffle(names)
    rows = [(rng.choice("iiik"), k, x) for k, x in enumerate(names)] + [(None, 10_000, "abc")]
    table = spark.createDataFrame(rows, "item string, k long, name string").repartition(3)
    got = matching.links(table, ["item"], "name", "k", similar)
    want = brute_links(rows, similar)
    assert {x.k: (x.class_id, x.links) for x in got.collect()} == want and got.count() == len(rows)
    assert matching.links(table.limit(0), ["item"], "name", "k", similar).count() == 0


def test_names_in_one_order_only(spark):
    """``diet`` then ``tide`` have one matching block, ``tide`` then ``diet`` two."""
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    assert ratio("tide", "diet") != ratio("diet", "tide")
    similar = max(ratio("tide", "diet"), ratio("diet", "tide"))
    rows = [("i", k, x) for k, x in enumerate(["tide", "diet", "diet", "tide", "tide", "diet", "x", "tide"])]
    got = matching.links(spark.createDataFrame(rows, "item string, k long, name string"), ["item"], "name", "k", similar).collect()
    assert {x.k: (x.class_id, x.links) for x in got} == brute_links(rows, similar)


def test_links_of_a_large_host(spark):
    """Eight million links of one host, counted without a row for each."""
    names = [f"{k * 7919 % 1_000_003:06d}?utm_source=feed" for k in range(4000)] + [f"{k * 7919 % 100_003:05d}" for k in range(500)]
    rows = [("i", k, x) for k, x in enumerate(names)]
    got = {x.k: x.links for x in matching.links(spark.createDataFrame(rows, "item string, k long, name string"), ["item"], "name", "k").collect()}
    assert {got[k] for k in range(4000)} == {3999} and len(got) == 4500


def test_near_questions_of_a_novel(spark):
    long = "Who of the guests at the old manor house took the silver spoon from the drawer in the kitchen " * 3
    rows = [(1, 1, long), (1, 2, long + "?"), (2, 1, long), (1, 3, "What else"), (1, 4, None)]
    told = ingest.near_duplicates(spark.createDataFrame(rows, "novel_id int, ord int, question string")).collect()
    assert [(x.novel_id, x.i, x.j) for x in told] == [(1, 1, 2)]


def test_indel_ratio_by_expression(spark):
    rows = spark.createDataFrame([("john smith", "jon smith"), ("", ""), ("a", "")], "a string, b string")
    assert [tuple(x) for x in rows.select(indel_ratio("a", "b"), alike.subsequence_ratio("a", "b")).collect()] == [pytest.approx((r, r)) for r in (18 / 19, 1.0, 0.0)]
