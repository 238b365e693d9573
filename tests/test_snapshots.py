"""Bars that are cut anywhere and resumed equal bars of the whole tape."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sampling, snapshots
from tidemark.operators.sampling import Topic

TOPICS = tuple(Topic(m, "price", m) for m in sampling.MODES)


@pytest.fixture(scope="module")
def tape(spark):
    rnd = random.Random(22)
    rows = [(rnd.choice("aaab"), float(rnd.randint(0, 400)), i, rnd.choice([None, float(rnd.randint(0, 5))]), float(rnd.randint(0, 4))) for i in range(300)]
    return spark.createDataFrame([*rows, ("only early", 1.0, 900, 7.0, 1.0), ("only late", 399.0, 901, None, 1.0)], "ticker string, ts double, seq long, price double, volume double").cache()


def rows_of(df):
    out = {}
    for r in df.collect():
        out[r["ticker"], r["idx"]] = {m: r[m] for m in sampling.MODES}
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        for m, x in w.items():
            assert (got[k][m] == x) if x is None or m == "store" else got[k][m] == pytest.approx(x), (k, m)


@pytest.mark.parametrize(("cuts", "size"), [((0.0,), 1), ((133.0,), 1), ((200.0,), 4), ((61.0, 62.0, 300.5), 2), ((1000.0,), 2)])
def test_resumed_bars(spark, tape, tmp_path, cuts, size):
    index = sampling.time_index(60.0)
    want = rows_of(sampling.bars(tape, TOPICS, index))
    edges, closed, states = [-1.0, *cuts, 1e9], {}, None
    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        part = tape.where((F.col("ts") >= a) & (F.col("ts") < b))
        bars = snapshots.partial_bars(part, TOPICS, index) if states is None else snapshots.resume(part, states, TOPICS, index)
        closed |= rows_of(snapshots.finished(bars, TOPICS))  # what a ring holds comes again, and counts as it is then
        snapshots.save(snapshots.snapshot(bars, TOPICS, size), f"{tmp_path}/{n}")
        states = snapshots.load(spark, f"{tmp_path}/{n}")
    same(closed, want)
    ring = snapshots.restored(states, TOPICS).collect()
    assert all(len(r["ring"]) <= size and [x["idx"] for x in r["ring"]] == sorted(i for t, i in want if t == r["ticker"])[-len(r["ring"]) :] for r in ring)


def test_empty_tape(tape):
    none = tape.where("false")
    parts = snapshots.partial_bars(none, TOPICS, sampling.time_index(60.0))
    assert snapshots.snapshot(parts, TOPICS, 2).count() == 0 and snapshots.finished(snapshots.merged_bars(parts, TOPICS), TOPICS).count() == 0
