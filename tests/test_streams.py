"""Steps in order as a stream: gaps, other first numbers, late and repeated steps, state that ends."""

from __future__ import annotations

import json
import os
import time

import pytest

from lumenfold.streaming import fold


@pytest.fixture
def feed(spark, tmp_path):
    """Runs a stream over what has come so far, one batch after the other from one checkpoint, and tells the new rows."""
    src, n = tmp_path / "in", [0]
    src.mkdir()
    # a query with timers has batches without data for ever; here each run is to end
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def run(made, rows, wait=0.0):
        time.sleep(wait)
        n[0] += 1
        (src / f"tmp{n[0]}").write_text("\n".join(json.dumps(dict(zip(("item", "k", "t"), r, strict=True))) for r in rows))
        os.rename(src / f"tmp{n[0]}", src / f"f{n[0]}.json")
        got = []
        query = made(spark.readStream.schema("item string, k long, t string").json(str(src))).writeStream
        query.foreachBatch(lambda batch, _: got.extend(tuple(x) for x in batch.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(got, key=str)

    yield run
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def joined(**how):
    return lambda stream: fold.summaries(stream, "item", "k", "t", lambda before, chunk: (before or "") + chunk, **how)


def test_a_gap_is_given_up_and_reported(feed):
    made = joined(patience=1500)
    assert feed(made, [("x", 0, "a"), ("x", 2, "c"), ("x", 3, "d"), ("y", 1, "q")]) == [("x", 1, "a", "made")]
    # another item's rows start a batch after the timers: x goes on without step 1, y without step 0
    got = feed(made, [("z", 0, "z")], wait=2.0)
    assert got == [("x", 2, None, "missing"), ("x", 3, "ac", "made"), ("x", 4, "acd", "made"), ("y", 1, None, "missing"), ("y", 2, "q", "made"), ("z", 1, "z", "made")]
    # the late step is told apart from one that comes again
    assert feed(made, [("x", 1, "b"), ("x", 3, "d"), ("x", 4, "e")]) == [("x", 2, None, "late"), ("x", 5, "acde", "made")]


def test_other_first_numbers_repeats_and_odd_rows(feed):
    made = joined(first=1)
    assert feed(made, [("x", 2, "b"), ("x", 2, "B"), ("x", 0, "no"), ("x", None, "n"), (None, 1, "null")]) == [(None, 1, "null", "made")]
    assert feed(made, [("x", 1, None), ("x", 2, "again"), ("x", 3, "c")]) == [("x", 1, "", "made"), ("x", 2, "b", "made"), ("x", 3, "bc", "made")]
    assert feed(made, [("x", 1, "a"), ("x", 3, "c")]) == []


def test_state_ends(feed):
    made = joined(idle=1000)
    assert feed(made, [("x", 0, "a"), ("x", 1, "b")]) == [("x", 1, "a", "made"), ("x", 2, "ab", "made")]
    assert feed(made, [("y", 0, "q")], wait=1.5) == [("y", 1, "q", "made")]
    # nothing is known of x any more
    assert feed(made, [("x", 0, "new")]) == [("x", 1, "new", "made")]


def test_continuity_doesnt_compare_across_a_gap(feed):
    made = lambda stream: fold.continuity(stream, "item", "k", "t", patience=1000)
    assert feed(made, [("x", 1, "a b d"), ("x", 0, "a b c"), ("x", 3, "a b"), ("x", 4, "a b")]) == [("x", 1, 1, 0.5, "made")]
    assert feed(made, [("y", 0, "")], wait=1.5) == [("x", 2, None, None, "missing"), ("x", 4, 1, 1.0, "made")]
