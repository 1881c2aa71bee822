"""Registered queries against their SQL twins on the smallest tables, and those without a twin against brute force."""

import collections
import os

import pytest

from lumenfold.operators import overlap
from lumenfold.plans import comparisons, more, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in queries.ORACLES if queries.QUERIES[n].__module__ in (more.__name__, comparisons.__name__)])
def test_query_equals_its_sql(spark, duck, name):
    df, told = queries.QUERIES[name](spark, SF), duck.execute(queries.ORACLES[name])
    at = [x[0] for x in told.description]
    assert sorted(at) == sorted(df.columns)
    want = sorted(str(tuple(r[at.index(n)] for n in sorted(at))) for r in told.fetchall())
    assert sorted(str(tuple(r[n] for n in sorted(at))) for r in df.collect()) == want


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_stemmed_overlap_is_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    stems = {(x.conv_id, x.turn): [overlap.porter_stem(w) for w in overlap.plain_tokens(x.text)] for x in rows}
    got = {(x.conv_id, x.turn, x.metric): (x.precision, x.recall, x.f1) for x in more.rouge_stemmed(spark, SF).collect()}
    milli = lambda v: int(v * 1e5 + 0.5)
    seen = 0
    for (conv, turn), p in stems.items():
        if (conv, turn - 1) not in stems:
            continue
        t, seen = stems[conv, turn - 1], seen + 1
        counts = [(f"rouge-{n}", *(collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for w in (t, p))) for n in range(1, 5)]
        hits = {name: (sum((a & b).values()), a.total(), b.total()) for name, a, b in counts} | {"rouge-l": (_lcs(t, p), len(t), len(p))}
        for name, (o, nt, np) in hits.items():
            precision, recall = o / np if np else 0, o / nt if nt else 0
            f1 = 2 * precision * recall / (precision + recall) if o else 0
            assert all(abs(x - milli(y)) <= 1 for x, y in zip(got[conv, turn, name], (precision, recall, f1), strict=True))
    assert len(got) == 5 * seen > 0


def test_sentence_overlap_is_brute_force(spark):
    """Members of common subsequences by the plain table of pairs of positions."""

    def members(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
        return table[-1][-1]

    for x in spark.read.parquet(f"{SF}/conversations.parquet").limit(20).collect():
        w = overlap.plain_tokens(x.text)
        a, b = w[: len(w) // 2], w[len(w) // 3 :]
        kept = sorted(overlap.lcs_members(a, b))
        assert len(kept) == members(a, b) == overlap.lcs_length(a, b) and _lcs([a[k] for k in kept], b) == len(kept)
