"""Vector codes against plain Lloyd's rounds."""

from __future__ import annotations

import numpy as np
import pytest

from lumenfold.llm import codes, queries
from lumenfold.llm._vectors import whole_numbers


def plain(x: np.ndarray, order: np.ndarray, parts: int, entries: int, rounds: int):
    """Full scans: codes, errors and codebooks of rows ``x``; ``order`` sorts them by id."""
    x = x.reshape(len(x), parts, -1)
    books = x[order[:entries]].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        near = d.argmin(2)
        if step < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = x[near[:, p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(0) // len(own)
    return near, d.min(2).sum(1), books


@pytest.mark.parametrize("case", ["clusters", "ties", "wide"])
def test_bounds_never_change_a_result(case):
    rng = np.random.default_rng(4)
    x = {"clusters": rng.normal(size=(3000, 8)) * 20 + rng.integers(-500, 500, (30, 8))[rng.integers(0, 30, 3000)], "ties": rng.integers(-2, 3, (3000, 8)), "wide": rng.normal(size=(500, 8)) * 2**22}[case].astype(np.int64)
    book = x[:16].copy()
    groups = codes.grouped(book, 4)
    assert sorted(np.concatenate(groups).tolist()) == list(range(16))
    a, upper, lower, moved, computed = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros((len(x), len(groups))), None, []
    for _ in range(12):
        computed.append(codes.reassign(x, book, groups, moved, a, upper, lower))
        d = ((x[:, None, :] - book) ** 2).sum(2)
        assert (a == d.argmin(1)).all()
        fresh = np.array([x[a == e].sum(0) // max(1, (a == e).sum()) if (a == e).any() else book[e] for e in range(16)])
        moved = np.sqrt(((fresh - book).astype(float) ** 2).sum(1)) * (1 + codes.SLACK)
        book = fresh
    if case == "clusters":
        assert computed[-1] < 0.25 * computed[0]


def test_codes_are_those_of_full_scans(spark):
    rng = np.random.default_rng(7)
    v = rng.integers(-50, 50, (700, 12))
    ids = rng.permutation(700) - 100
    table = spark.createDataFrame([(int(i), "x", row.tolist()) for i, row in zip(ids, v, strict=True)], "vec_id long, c0 string, v array<long>").repartition(5)
    got, books, computed = codes.compress(table, parts=4, entries=6, rounds=5, groups=2)
    near, error, want = plain(v, np.argsort(ids), 4, 6, 5)
    assert (books == want).all() and got.columns == ["vec_id", "c0", "code", "error"]
    by = {x.vec_id: x for x in got.collect()}
    assert [by[i].code for i in ids.tolist()] == ["".join(f"{e:02x}" for e in row) for row in near] and [by[i].error for i in ids.tolist()] == error.tolist()
    assert len(computed) == 6 and computed[-1] < computed[0]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 8, 1), (2, None, 1), (3, [nan] * 8, None), (4, [inf] + [0.0] * 7, 1), (5, [None] + [0.0] * 7, 1), (6, [-0.5] * 8, None), (6, [-0.5] * 8, None), (None, [0.25] * 8, 2), (7, [1.0] * 3, 2), (8, [], 2), (9, [1e30] * 8, 2), (10, [-0.5] * 8, 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'mine' as code", "7 as state").withColumn("v", whole_numbers("embedding", 4096))
    got, books, _ = codes.compress(table)
    kept = [r for r in got.collect()]
    assert got.columns == ["vec_id", "embedding", "label", "state", "code", "error"]
    # null, non-finite and too large ones go, and one of three components
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in kept) == [(False, 1), (False, 6), (False, 6), (False, 10), (True, 0)]
    assert books.shape == (8, 5, 1) and all(r.error == 0 for r in kept)
    # equal entries: the lower index is taken
    assert {r.code for r in kept if r.vec_id in (6, 10)} == {"01" * 8}
    none, empty, _ = codes.compress(table.limit(0))
    assert none.count() == 0 and none.columns == got.columns and empty.size == 0
    # parts that don't divide the components
    three, books, _ = codes.compress(table.where("vec_id = 7"), parts=2, entries=2)
    assert three.collect()[0].code == "0000" and books.tolist() == [[[4096, 4096]], [[4096, 0]]]


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    x = np.floor(4096 * np.array(rows.embedding.tolist(), dtype=float)).astype(np.int64)
    near, error, books = plain(x, np.argsort(rows.vec_id.to_numpy()), 8, 16, 6)
    got = queries.op12_vector_codes(spark, "/root/testdata/sf0.001").toPandas().set_index("vec_id")
    by_label = rows.assign(error=error).groupby("label", dropna=False).error.sum()
    assert len(got) == len(rows) and set(got.codebooks_sha256) == {codes.digest(books)}
    for k, name in enumerate(rows.vec_id):
        assert tuple(got.loc[name][["code", "error", "label_error"]]) == ("".join(f"{e:02x}" for e in near[k]), error[k], by_label[rows.label[k]])
