"""Missing, infinite and repeated values: each has one meaning everywhere."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.functions import scalars as X
from riskframe.operators import evaluate as EV
from riskframe.operators import features as FE
from riskframe.operators import profile as PR
from riskframe.operators import report as R
from riskframe.operators import windows as WN
from riskframe.plans import jobs as J

NAN, INF = float("nan"), float("inf")


def amounts(spark, *values):
    return spark.createDataFrame([(i, 1, v) for i, v in enumerate(values)], "transaction_id long, customer_id long, Amount double")


def test_means_leave_nan_out_and_carry_infinity(spark):
    def mean(*v):
        return amounts(spark, *v).agg(X.exact_avg("Amount"), X.exact_sum("Amount")).first()

    assert mean(1.0, 2.0, NAN) == (1.5, 3.0) and mean(1.0, None) == (1.0, 1.0) and mean(NAN, None) == (None, None)
    assert mean(1.0, 2.0, INF) == (INF, INF) and mean(-INF, 1.0) == (-INF, -INF) and math.isnan(mean(INF, -INF)[0])
    p = FE.customer_profile(amounts(spark, 1.0, 2.0, NAN)).first()
    assert (p["avg_amount_per_customer"], p["tx_count"]) == (1.5, 3)
    s = PR.dataset_summary(amounts(spark, 1.0, 2.0, 6.0, NAN).withColumn("Class", F.lit(0))).first()
    assert (s["rows"], s["amount_mean"], s["amount_max"], s["amount_median"]) == (4, 3.0, 6.0, 2.0)


def test_histogram_and_box_of_known_values(spark):
    df = amounts(spark, 0.0, 1.0, 2.0, 10.0, NAN, None, INF)
    h = {r["bin"]: (r["lower"], r["upper"], r["n"]) for r in PR.histogram(df, "Amount", 5).collect()}
    assert h == {0: (0.0, 2.0, 2), 1: (2.0, 4.0, 1), 4: (8.0, 10.0, 1)}
    b = PR.box_stats(amounts(spark, *[float(i) for i in range(9)], 1000.0, NAN, None).withColumn("Class", F.lit(1)), "Amount").first()
    assert b["outliers"] == 1 and b["whisker_high"] == 8.0


def test_rows_without_a_value_get_no_label(spark):
    df = amounts(spark, 10.0, 700.0, NAN, None)
    assert {r["amount_range"]: r["n"] for r in R.amount_buckets(df).collect()} == {"0-50": 1, "500+": 1, "unknown": 2}
    s = spark.createDataFrame([(i, p) for i, p in enumerate([0.1, 0.2, 0.3, 0.4, NAN, None])], "transaction_id long, fraud_probability double")
    assert [r["risk_quartile"] for r in WN.quartile_labels(s).orderBy("transaction_id").collect()] == ["Low", "Medium", "High", "Critical", None, None]
    t = s.select(X.merchant_status("fraud_probability"), X.drift_severity("fraud_probability"))
    assert [tuple(r) for r in t.collect()][-2:] == [(None, None), (None, None)]


def test_average_divides_by_known_amounts(spark):
    df = amounts(spark, 10.0, 20.0, NAN, None).withColumns({"ts": F.to_timestamp(F.lit("2024-01-01 05:00:00")), "fraud_probability": F.lit(0.9)})
    r = R.daily_volume(df).first()
    assert (r["volume"], r["avg_amount"], r["blocked_amount"]) == (4, 15.0, 30.0)


def test_rows_without_a_label_are_not_negatives(spark):
    rows = [("m", 0.9, 1), ("m", 0.8, None), ("m", 0.7, 0), ("m", 0.2, None)]
    s = spark.createDataFrame(rows, "model string, score double, label int")
    c = EV.curve(s).agg(F.max("P"), F.max("N"), F.max("fp")).first()
    assert tuple(c) == (1, 1, 1) and EV.auc(s).first()["auc"] == 1.0
    df = s.select(F.col("score").alias("p"), F.col("label").alias("Class"))
    assert EV.leaderboard(df, {"m": "p"}).first()["accuracy"] == 1.0


def test_score_history_keeps_every_row_once(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (1, 2.0, 20.0), (None, 3.0, 30.0), (2, 4.0, 400.0)], "transaction_id long, Time double, Amount double")
    score = lambda d: d.withColumn("p_m", F.least(F.col("Amount") / 500.0, F.lit(1.0)))
    out = J.score_history(df, score, "m", required=("Time", "Amount"), batch_size=3)
    got = sorted((r["transaction_id"][:3], r["fraud_probability"]) for r in out["predictions"].collect())
    assert [g[1] for g in got] == [0.02, 0.04, 0.8, pytest.approx(0.06)] and got[3][0] == "tx_"
    assert sorted(r["total_transactions"] for r in out["batches"].collect()) == [1, 3]
    assert out["rollup"].first()["total_transactions"] == 4


def test_point_in_time_rate(spark):
    rows = [(0, 1, 1.0, 1), (1, 1, 1.0, 0), (2, 1, 2.0, None), (3, 1, 2.0, 1), (4, 1, 3.0, 0), (5, 1, None, 1), (6, None, 1.0, 1), (7, None, 5.0, 0), (8, 2, 9.0, 1)]
    df = spark.createDataFrame(rows, "transaction_id long, merchant_id long, Time double, Class int")
    got = {r["transaction_id"]: r["merchant_fraud_rate"] for r in FE.earlier_rate(df).collect()}
    assert got == {0: None, 1: None, 2: 0.5, 3: 0.5, 4: pytest.approx(2 / 3), 5: None, 6: None, 7: 1.0, 8: None}
    full = FE.engineer_features(df.withColumns({"customer_id": F.lit(1), "Amount": F.lit(1.0)}), rate="earlier")
    assert {r["transaction_id"]: r["merchant_fraud_rate"] for r in full.collect()}[4] == pytest.approx(2 / 3)


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_by_counting(spark, seed):
    import numpy as np
    import pandas as pd

    from riskframe.operators import stats

    rng = np.random.default_rng(seed)
    x = [rng.normal(size=30_001), np.round(rng.pareto(0.3, 25_000), 2), np.r_[np.full(20_000, 7.25), rng.integers(0, 9, 5000)],
         np.r_[rng.normal(size=24_000) * 1e-300, 1e308, -1e308, rng.normal(size=500) * 1e300]][seed].astype(float)
    df = spark.createDataFrame(pd.DataFrame({"v": np.r_[x, np.nan]})).repartition(5)
    qs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = stats.exact_quantiles(df, "v", qs).first()
    with np.errstate(over="ignore"):
        assert list(got) == pytest.approx(list(np.quantile(x, qs)), rel=1e-12, abs=0)
    few = stats.FEW
    try:
        stats.FEW = 0  # counting alone, down to single values
        assert list(stats.exact_quantiles(df, "v", qs).first()) == list(got)
    finally:
        stats.FEW = few


def test_quantiles_of_infinities_and_of_nothing(spark):
    from riskframe.operators import stats

    assert tuple(stats.exact_quantiles(amounts(spark, -INF, 1.0, 2.0, INF, INF), "Amount", [0.0, 0.25, 0.5, 0.9]).first()) == (-INF, 1.0, 2.0, INF)
    assert tuple(stats.exact_quantiles(amounts(spark, NAN, None), "Amount", [0.5]).first()) == (None,)
    assert tuple(stats.exact_quantiles(amounts(spark, 3.0), "Amount", [0.25]).first()) == (3.0,)


def test_sketches_merge_like_one_pass(spark, tmp_path):
    from riskframe.operators import sketches as SK

    df = spark.range(30_000).selectExpr("id % 30 as day", "id % 7000 as customer_id", "case when id % 11 = 0 then double('NaN') else id / 3.0 end as Amount")
    path = str(tmp_path / "s")
    for lo in (0, 10, 20, 10):  # one batch stored twice
        SK.store(SK.summarise(df.where(f"day >= {lo} and day < {lo + 10}"), ["day"], ["customer_id"], ["Amount"]), path, str(lo))
    got = SK.rollup(SK.stored(spark, path), []).first()
    assert got["rows"] == 30_000 and abs(got["distinct_customer_id"] - 7000) < 350
    assert all(abs(got[f"q_{q}_Amount"] - 10_000 * q / 100) < 200 for q in (25, 50, 75))
    empty = SK.rollup(SK.summarise(df.where("day < 0"), ["day"], ["customer_id"], ["Amount"]), ["day"])
    assert empty.count() == 0
    nan = SK.rollup(SK.summarise(df.where("isnan(Amount)"), ["day"], [], ["Amount"]), [])
    assert nan.first()["q_50_Amount"] is None
