"""Near copies against the Jaccard similarity of all pairs of texts, without any candidate search."""

import re

import numpy as np
import pyarrow as pa
import pytest
from test_operators import odd_docs

from lumenfold.llm import simhash


def plain_set(text: str) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_groups(ids: list[int], texts: list[str]) -> dict[int, int]:
    """Smallest id of each row's group over all pairs of 0.8 or more."""
    sets = [plain_set(t) for t in texts]
    boss = list(range(len(sets)))

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or (4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)):
                a, b = sorted((find(i), find(j)), key=ids.__getitem__)
                boss[b] = a
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def found(df) -> dict[int, int]:
    return {x.doc_id: x.component_id for x in simhash.near_copies(df).collect()}


@pytest.mark.parametrize("part", [4096, 5])
def test_groups_are_those_of_all_pairs_from_0_6_to_1(spark, monkeypatch, part):
    """Copies with up to 25 of 200 words changed: some pairs are a little over 0.8 and some a little under."""
    monkeypatch.setattr(simhash, "PART_TEXTS", part)
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(200)]
        for changes in (0, 3, 4, 5, 6, 9):
            changed = list(base)
            for at in rng.choice(200, changes, replace=False):
                changed[at] = word()
            texts.append(" ".join(changed))
    texts += [" ".join(x) for x in (["a"] * 3, ["a"] * 50, ["A"] * 51, [])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert found(df) == plain_groups(list(range(len(texts))), texts)


def test_texts_that_share_words_but_not_shingles_stay_apart(spark):
    """Changing every fifteenth word leaves most two-word shingles but only two thirds of the five-word ones."""
    base = [f"w{k * 7919 % 5003}" for k in range(300)]
    other = [w + "x" if k % 15 == 7 else w for k, w in enumerate(base)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string")
    assert found(df) == {1: 1, 2: 2}


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    assert found(docs) == plain_groups([x.doc_id for x in rows], [x.text for x in rows])


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = simhash.near_copies(docs).collect()
    assert len(got) == docs.count() and all(x.component_id is None for x in got if x.doc_id is None)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 6").count() == 0 and kept.where("doc_id = 5").count() == 1
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_whole_texts_go_to_python_in_small_batches(spark):
    """A worker holds several times a batch of whole texts; 1,000 rows of them took an executor over its memory."""
    from lumenfold.llm._common import small_batches

    small_batches(spark)
    sizes = spark.range(2000).coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [x.num_rows]}) for x in batches), "n long").collect()
    assert sum(x.n for x in sizes) == 2000 and max(x.n for x in sizes) <= 250
