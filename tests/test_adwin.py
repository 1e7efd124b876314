"""Batch ADWIN against the sequential detector."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from riskframe.operators import adwin as A
from riskframe.operators import drift as DR
from riskframe.streaming.state import AdwinDetector


def frame(spark, x, t=None):
    n = len(x)
    return spark.createDataFrame(pd.DataFrame({"transaction_id": np.arange(n), "Time": np.arange(n) * 60.0 if t is None else t, "Amount": x}))


def sequential(x):
    found = AdwinDetector().update_many(np.asarray(x, float))
    return found[0] if found else None


def test_bounds_are_those_of_the_sequential_histogram():
    d = AdwinDetector(delta=1e-300)
    for t in range(1, 700):
        d._insert(np.zeros(32))
        ends = np.cumsum([b[0] for b in d.buckets]) // 32
        assert A.histogram_bounds(t) == [int(e) for e in ends[:-1]]


@pytest.mark.parametrize("shift,spread", [(0.6, 1.0), (0.15, 1.0), (0.0, 1.0), (-3.0, 40.0)])
def test_equals_a_sequential_fold(spark, shift, spread):
    rng = np.random.default_rng(int(abs(shift) * 100))
    x = rng.normal(10, spread, 100_000)
    x[61_234:] += shift
    df = frame(spark, x).repartition(7)
    want = sequential(x)
    # blocks far smaller than the table, and one that holds it
    for block in (256, 1 << 15):
        got = A.first_drift(df, order=["Time", "transaction_id"], block=block).first()
        assert (got["end"] * 32 if got else None) == want
    if want:
        n0 = got["n0"]
        assert got["mu0"] == pytest.approx(x[:n0].mean()) and got["mu1"] == pytest.approx(x[n0:want].mean())
        assert got["cut_time"] == (n0 - 1) * 60.0 and got["end_time"] == (want - 1) * 60.0


def test_all_cuts_in_blocks_equal_all_cuts_in_one(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, rng.normal(0, 1, 6000))
    key = ["end", "cut"]
    a, b = (A.adwin_cuts(df, order=["Time", "transaction_id"], block=k).toPandas().sort_values(key).reset_index(drop=True) for k in (16, 1 << 15))
    pd.testing.assert_frame_equal(a, b)
    assert list(zip(a["end"], a["cut"])) == [(t, c) for t in range(1, 188) for c in A.histogram_bounds(t)]


def test_a_block_that_drifts_throughout_is_folded_in_little_memory():
    n = A.BLOCK
    c = np.arange(1, n + 1)
    up = np.cumsum(c * 32.0)  # values rise from grain to grain, so every histogram drifts
    pdf = pd.DataFrame({"own": True, "c": c, "s": up, "ss": np.cumsum(c * c * 32.0), "t": c * 1.0})
    every = A._fold(pdf, 0.0, 32, 5, 0.002, 5, True)
    tracemalloc.start()
    first = A._fold(pdf, 0.0, 32, 5, 0.002, 5, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = every[every["drift"] & (every["end"] == every.loc[every["drift"], "end"].min())]
    pd.testing.assert_frame_equal(first.reset_index(drop=True), want.reset_index(drop=True))
    assert len(every) < 1_000_000 and peak < 32 << 20


def test_a_stray_timestamp_changes_nothing(spark):
    x = np.r_[np.full(2400, 10.0), np.full(1200, 100.0)] + np.arange(3600) % 3
    t = 1.7e9 + np.arange(3600) * 600.0
    clean = DR.adwin_alert(frame(spark, x, t)).first()
    stray = DR.adwin_alert(frame(spark, np.r_[x, 11.0], np.r_[t, 0.0])).first()
    assert stray["old_value"] == pytest.approx(clean["old_value"], rel=0.01) and stray["new_value"] == pytest.approx(clean["new_value"], rel=0.3)
    assert abs(stray["detected_time"] - clean["detected_time"]) <= 32 * 600


def test_large_amounts_and_missing_ones(spark):
    rng = np.random.default_rng(4)
    x = 1e12 + rng.normal(0, 1, 8000)
    x[5000:] += 5.0
    got = A.first_drift(frame(spark, x), order=["Time"]).first()
    n0, n = got["n0"], got["end"] * 32
    assert n == sequential(x - 1e12) and got["mu1"] - got["mu0"] == pytest.approx((x[n0:n] - 1e12).mean() - (x[:n0] - 1e12).mean(), abs=0.01)
    holes = x.copy()
    holes[::7], holes[3::91] = np.nan, np.inf
    got = A.first_drift(frame(spark, holes), order=["Time"]).first()
    assert got["end"] * 32 == sequential((holes - 1e12)[np.isfinite(holes)])
    assert A.first_drift(frame(spark, x[:40]), order=["Time"]).count() == 0
    assert A.first_drift(frame(spark, x).limit(0), order=["Time"]).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        A.adwin_cuts(frame(spark, x), block=100)
