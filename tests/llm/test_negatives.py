"""Hard negatives against sorting all rows of an anchor."""

from __future__ import annotations

import numpy as np
import pytest

from lumenfold.llm import negatives, queries
from lumenfold.llm._vectors import whole_numbers

SF = "/root/testdata/sf0.001"


def plain(rows, anchors, positives=5, wanted=10, low=30, high=90):
    """rows: (id, label, vector of ints)."""
    out = []
    for a, label, v in anchors:
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in rows if len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label and x[1] != a][:positives]:
            inside = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:wanted]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(inside)]
    return sorted(out)


def test_query(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(256 * np.asarray(e, dtype=float)).astype(int).tolist()) for i, e, label in zip(t.vec_id.tolist(), t.embedding, t.label.tolist(), strict=True)]
    got = sorted(map(tuple, queries.op13_hard_negatives(spark, SF).collect()))
    assert got == plain(rows, [x for x in rows if x[0] % 100 == 0]) and len(got) > 50


@pytest.mark.parametrize("digit", [2, 8])
def test_windows_with_ties_and_several_waves(spark, monkeypatch, digit):
    for name, value in (("BLOCK", 64), ("ANCHORS", 3), ("WAVE", 5), ("DIGIT", digit), ("SPARE", 1)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(8)
    # a third of all rows are one vector, whose scores tie: only the digits of ids tell them apart
    rows = [(int(i) * 7 - 600, int(i % 4), rng.integers(-9, 30, 6).tolist() if i % 3 else [9, 8, 7, 6, 5, 4]) for i in rng.permutation(300)]
    anchors = [x for x in rows if x[0] % 5 == 0][:13]
    table = lambda x: spark.createDataFrame(x, "vec_id long, label int, v array<long>").repartition(3)
    got = sorted(map(tuple, negatives.mine(table(rows), table(anchors), positives=3, negatives=4).collect()))
    assert got == plain(rows, anchors, 3, 4)


def test_large_products_are_exact(spark):
    big = 1 << 26
    rows = [(0, 1, [big, 1]), (1, 1, [big, big]), (2, 2, [big // 2, big // 2 + 1]), (3, 2, [big // 2, big // 2]), (4, 2, [big // 2 + 1, 0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, v array<long>")
    assert sorted(map(tuple, negatives.mine(table, table.where("vec_id = 0")).collect())) == plain(rows, rows[:1])


def test_odd_rows(spark):
    nan = float("nan")
    good = [(1, 1, [1.0, 0.5]), (2, 1, [1.0, 0.25]), (3, 2, [0.5, 0.5]), (4, 2, [0.5, 0.5]), (4, 2, [0.5, 0.5])]
    odd = [(5, None, [1.0, 1.0]), (6, 1, None), (7, 2, [nan, 1.0]), (8, 2, [None, 1.0]), (9, 2, [0.5]), (10, 2, []), (None, 2, [0.5, 0.5]), (11, 2, [1e30, 1.0])]
    table = spark.createDataFrame(good + odd, "vec_id long, label int, embedding array<float>").selectExpr("*", "'x' as dim", "'y' as score").withColumn("v", whole_numbers("embedding", 256))
    whole = [(i, label, [int(256 * x) for x in v]) for i, label, v in good]
    # rows that repeat count each, an anchor that repeats counts once; one of one component meets none
    anchors = table.where("vec_id in (1, 4, 5, 9)")
    assert sorted(map(tuple, negatives.mine(table, anchors).collect())) == plain(whole, [whole[0], whole[3]])
    assert negatives.mine(table, table.limit(0)).count() == 0 and negatives.mine(table.limit(0), anchors).count() == 0
    assert negatives.mine(table, anchors).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
