"""Suffix automata and the removal of passages against all windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import automata, queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def plain(docs, window):
    """(id, words, removed, kept) of each (id, text)."""
    first: dict[tuple, int] = {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = {j for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abc"), max_size=14), max_size=5), st.text(st.sampled_from("abcd"), max_size=14), st.integers(1, 6))
def test_statistics_are_the_longest_strings_held(given_texts, text, most):
    automaton = automata.Automaton()
    for k, held in enumerate(given_texts):
        automaton.add(held, 10 - k)
    automaton = automata.Automaton.loaded(automaton.dumped())
    for end, (size, doc) in enumerate(automaton.statistics(text, most), 1):
        sizes = [n for n in range(min(end, most) + 1) if any(text[end - n : end] in held for held in given_texts)]
        assert size == max(sizes, default=0)
        if size:
            assert doc == min(10 - k for k, held in enumerate(given_texts) if text[end - size : end] in held)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {x.doc_id: tuple(x) for x in queries.op11_substring_dedup(spark, SF).collect()}
    want = plain(docs, 50)
    assert len(got) == len(docs) and sum(w[2] > 0 for w in want) > 3
    for i, n, removed, kept in want:
        assert got[i] == (i, n, removed, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize(("hot", "shard", "crowded"), [(500, 50_000, 500), (1, 50, 1), (3, 1, 1e9)])
def test_made_up_texts(spark, monkeypatch, hot, shard, crowded):
    monkeypatch.setattr(automata, "HOT", hot)
    monkeypatch.setattr(automata, "SHARD_WORDS", shard)
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(rng.choice([f"w{k}" for k in range(300)], n))
    shared, other, phrase = words(60), words(90).split(), words(16)
    texts = [words(30) + " " + shared + "\n" + words(30), shared, " ".join(other), " ".join(other[20:75]) + "\t" + words(9), words(20) + "  " + " ".join(other[40:]), words(200)]
    texts += [words(40) + " " + phrase + " " + words(40) for _ in range(12)]  # one phrase in ever different surroundings
    texts += [texts[-1], texts[-2][:150] + " " + words(60), texts[5], texts[5].replace(" ", "\n"), "a " * 200, "a " * 57 + "b"]
    docs = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = plain(docs, 20)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept.encode()) for x in automata.remove_passages(table, 20).collect()}
    assert [got[i] for i, *_ in want] == [tuple(w[1:]) for w in want]
    told = {x.one: x for x in automata.passages(table, 20).collect()}
    for i, n, removed, kept in want:
        if i in told:
            assert (told[i].n_removed, bytes(told[i].kept)) == (removed, kept) and sum(s.end - s.begin for s in told[i].spans) == removed
        else:
            assert removed in (0, n)


def test_odd_rows(spark):
    long = " ".join(f"w{k * 7919 % 1000}" for k in range(30_000))
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, long), (6, long), (5, long), (None, long), (5, long + " more"), (7, "é " * 60), (8, "\x1c".join("ab" * 60)), (9, "  " * 55)]
    table = spark.createDataFrame([(*d, "x", "t") for d in docs], "doc_id long, text string, n_words string, t1 string")
    got = automata.remove_passages(table)
    assert got.columns == ["doc_id", "text", "t1", "n_words", "n_removed", "kept"]
    want = sorted((i is None, i or 0, n, gone, kept) for i, n, gone, kept in plain(docs, 50))
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_words, x.n_removed, x.kept.encode()) for x in got.collect()) == want
    assert automata.remove_passages(table.limit(0)).count() == 0
    short = automata.digests(table.limit(0))
    assert short.columns == ["id", "n_words", "n_removed", "kept_sha256"] and short.count() == 0


def test_references_are_broadcast_within_their_bound(spark, monkeypatch):
    monkeypatch.setattr(automata, "SHARD_WORDS", 4)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "x b c d e y")], "doc_id long, text string")
    references = spark.createDataFrame([("z b c d q",), ("c d e",), (None,), ("",)], "text string")
    got = {x.doc_id: (x.longest, [(s.begin, s.end) for s in x.spans]) for x in automata.held_by(docs, references, 3).collect()}
    assert got == {1: (3, [(1, 5)]), 2: (0, []), 3: (3, [(1, 5)])}
    assert {x.longest for x in automata.held_by(docs, references.limit(0), 3).collect()} == {0}
    monkeypatch.setattr(automata, "BROADCAST_WORDS", 5)
    with pytest.raises(ValueError, match="may be broadcast"):
        automata.held_by(docs, references, 3)
