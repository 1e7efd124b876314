"""Boosted trees against a plain version without blocks, tasks or tables."""

import numpy as np
import pandas as pd
import pytest

from riskframe.models import boost as B
from riskframe.operators import evaluate as EV


def plain_tree(bins, y, w, margin, depth, rate, min_child, gamma, reg):
    top = w.max()
    g, h = (a * (top / B.UNIT) for a in (x.astype(float) for x in B.gradients(y, w, margin, top)))
    size = 2 ** (depth + 1) - 1
    tree = B.Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))

    def grow(node, rows, deep):
        G, H = g[rows].sum(), h[rows].sum()
        best = (-np.inf, 0, 0)
        for f in range(len(bins) if deep < depth else 0):
            for cut in np.unique(bins[f, rows]):
                left = bins[f, rows] <= cut
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                if hl >= min_child and H - hl >= min_child:
                    gain = gl * gl / (hl + reg) + (G - gl) ** 2 / (H - hl + reg) - G * G / (H + reg)
                    best = max(best, (round(gain, 9), -f, -int(cut)))
        if best[0] / 2 - gamma > 0:
            f, cut = -best[1], -best[2]
            tree.feature[node], tree.cut[node] = f, cut
            left = bins[f, rows] <= cut
            grow(2 * node + 1, rows[left], deep + 1)
            grow(2 * node + 2, rows[~left], deep + 1)
        else:
            tree.value[node] = -rate * G / (H + reg)

    grow(0, np.arange(len(y)), 0)
    return tree


def table(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 3] = rng.integers(0, 3, n)
    x[rng.random(n) < 0.05, 1] = np.nan
    p = 1 / (1 + np.exp(-(2 * x[:, 0] * (x[:, 3] == 1) + np.nan_to_num(x[:, 1]) - 1)))
    y = (rng.random(n) < p).astype(int)
    return pd.DataFrame({**{f"x{k}": x[:, k] for k in range(4)}, "Class": y, "weight": np.where(y == 1, 3.0, 1.0)})


COLS = [f"x{k}" for k in range(4)]


@pytest.mark.parametrize("gamma,min_child", [(0.0, 3.0), (2.0, 40.0)])
def test_trees_equal_a_plain_version(spark, gamma, min_child):
    pdf = table(10_000)
    m = B.fit(spark.createDataFrame(pdf).repartition(5), COLS, rounds=2, depth=4, rate=0.3, subsample=1.0, colsample=1.0, min_child=min_child,
              gamma=gamma, bins=16)
    bins = m.bin(pdf[COLS].to_numpy())
    margin = np.zeros(len(pdf))
    for t in m.trees:
        want = plain_tree(bins, pdf["Class"].to_numpy(), pdf["weight"].to_numpy(), margin, 4, 0.3, min_child, gamma, 1.0)
        assert (t.feature == want.feature).all() and (t.cut == want.cut)[t.feature >= 0].all()
        np.testing.assert_allclose(t.value, want.value, rtol=1e-6, atol=1e-9)
        margin += t.value[t.nodes(bins)]
    assert (m.trees[0].feature >= 0).sum() > 3


def test_quality_round_trip_and_flush(spark, monkeypatch):
    monkeypatch.setattr(B, "FLUSH", 2)
    df = spark.createDataFrame(table(3000, 1)).repartition(3)
    m = B.fit(df, COLS, rounds=6, depth=3, rate=0.3, bins=32)
    s = m.score(df, "b")
    again = B.BoostModel.from_json(m.to_json()).score(df, "b")
    assert sorted(r["p_b"] for r in s.collect()) == sorted(r["p_b"] for r in again.collect())
    auc = EV.auc(EV.long_scores(s, {"b": "p_b"})).first()["auc"]
    one = B.fit(df, COLS, rounds=1, depth=3, rate=0.3, bins=32).score(df, "b")
    assert auc > 0.72 and auc > EV.auc(EV.long_scores(one, {"b": "p_b"})).first()["auc"]


def test_odd_rows(spark):
    rows = [(1.0, None, 1, 1.0), (None, 2.0, None, 1.0), (float("nan"), 5.0, 0, 2.0), (float("inf"), 1.0, 1, 1.0), (2.0, 1.0, 0, 1.0)] * 30
    df = spark.createDataFrame(rows, "a double, b double, Class int, weight double")
    m = B.fit(df, ["a", "b"], rounds=3, depth=2, subsample=1.0, colsample=1.0)
    assert m.score(df, "b").where("p_b between 0 and 1").count() == 150
    empty = B.fit(df.limit(0), ["a", "b"], rounds=3)
    assert empty.trees == [] and {r["p_b"] for r in empty.score(df, "b").collect()} == {0.5}
