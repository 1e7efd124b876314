"""Hand-made edge cases (FIXTURES.md section 7)."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe import schema as S
from riskframe.functions import scalars as X
from riskframe.models import classifiers as CL
from riskframe.models import iforest as IF
from riskframe.models import prepare as PP
from riskframe.operators import drift as DR
from riskframe.operators import evaluate as EV
from riskframe.operators import features as FE
from riskframe.operators import profile as PR
from riskframe.operators import report as R
from riskframe.operators import validate as VA
from riskframe.operators import windows as WN
from riskframe.sources import records as RC
from riskframe.sources import tables as TB


def test_band_ties_are_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,), (0.7,), (0.8,), (0.8000001,), (None,), (float("nan"),)],
                               "p double")
    got = [r[0] for r in df.select(X.risk_band("p")).collect()]
    assert got == ["Low", "Medium", "Medium", "Medium", "High", "Error", "Error"]
    hi = df.filter(F.col("p") > S.DASHBOARD_HIGH).count()
    assert hi == 3  # 0.7 itself is not high-risk


def test_threshold_classify_inclusive_vs_strict(spark):
    df = spark.createDataFrame([(0.5,)], "p double")
    assert df.select(X.threshold_classify("p", 0.5)).first()[0] == 1
    assert df.select(X.threshold_classify("p", 0.5, strict=True)).first()[0] == 0


def test_required_columns_and_target(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "Time double, Amount double")
    with pytest.raises(ValueError, match="V1"):
        VA.require_columns(df)
    with pytest.raises(ValueError, match="Class"):
        VA.split_target(df)
    assert VA.numeric_columns(df) == ["Time", "Amount"]
    out = VA.derive_if_absent(df, {"Amount": F.lit(0.0), "hour_of_day": F.lit(1)})
    assert out.first()["Amount"] == 2.0 and out.first()["hour_of_day"] == 1


def test_row_validation_text_negative_missing(spark):
    df = spark.createDataFrame([("1", "-5"), ("abc", "3"), (None, "2"), ("4", "7")], "Time string, Amount string")
    good, bad = VA.split_valid(df)
    assert good.count() == 1
    reasons = sorted(sum((r.violations for r in bad.collect()), []))
    assert reasons == ["missing:Time", "negative:Amount", "non_numeric:Time"]


def test_error_rows_are_isolated(spark):
    df = spark.createDataFrame([(1, 10.0, 100.0), (2, -1.0, 5.0), (3, 20.0, None)],
                               "transaction_id long, Time double, Amount double")
    out = CL.score_batch(df, lambda d: d.withColumn("p_m", F.lit(0.9)), name="m", required=("Time", "Amount")).orderBy(
        "transaction_id").collect()
    assert [r.risk_level for r in out] == ["High", "Error", "Error"]
    assert out[1].fraud_probability == 0.0 and "negative:Time" in out[1].error
    summary = R.batch_summary(spark.createDataFrame([(r.risk_level,) for r in out], "risk_level string"), by=None).first()
    assert summary.total_transactions == 3 and summary.high_risk_count + summary.medium_risk_count + \
        summary.low_risk_count == 1


def test_empty_batch_summary_and_rates(spark):
    e = spark.createDataFrame([], "risk_level string")
    s = R.batch_summary(e, by=None).first()
    assert s.total_transactions == 0 and s.fraud_rate == 0.0
    assert spark.range(1).select(X.safe_ratio(F.lit(3), F.lit(0))).first()[0] == 0.0


def test_one_class_only_evaluation(spark):
    df = spark.createDataFrame([(i, i / 10.0, 0) for i in range(10)], "id long, p double, Class int")
    s = EV.long_scores(df, {"m": "p"})
    assert EV.auc(s).first()["auc"] is None
    pr = EV.pr_curve(s).collect()
    assert all(r.recall == 1.0 for r in pr)  # no positives: recall defined as 1
    rep = EV.classification_report(EV.confusion(s, EV.threshold_for_precision(EV.pr_curve(s)))).collect()
    assert {r.class_label for r in rep} == {"0", "1", "accuracy", "macro avg", "weighted avg"}


def test_threshold_modes(spark):
    # scores 0.1..0.9, positives at 0.7, 0.8, 0.9 -> precision 1 from 0.7 up
    df = spark.createDataFrame([(i, i / 10.0, int(i >= 7)) for i in range(1, 10)], "id long, p double, Class int")
    pr = EV.pr_curve(EV.long_scores(df, {"m": "p"}))
    assert EV.threshold_for_precision(pr, 0.9, "exact").first()["threshold"] == 0.7
    assert EV.threshold_for_precision(pr, 0.9, "reference").first()["threshold"] == 0.6
    # the smallest score already meets the target -> reference returns 0.5
    allpos = spark.createDataFrame([(1, 0.2, 1), (2, 0.4, 1)], "id long, p double, Class int")
    pr2 = EV.pr_curve(EV.long_scores(allpos, {"m": "p"}))
    assert EV.threshold_for_precision(pr2, 0.9, "reference").first()["threshold"] == 0.5


def test_constant_and_all_null_columns(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, None)], "transaction_id long, c double, n double")
    nulls = {r.column_name: r.null_count for r in PR.null_profile(df).collect()}
    assert nulls == {"n": 2}
    h = PR.histogram(df, "c", 10).collect()
    assert len(h) == 1 and h[0].n == 2
    scaled = PP.fit_scaler(df, ["c"]).transform(df).first()
    assert scaled.c == 0.0  # zero std divides by 1
    assert PR.corr_matrix(df, ["c", "transaction_id"]).filter("col_a != col_b").first()["corr"] is None


def test_unseen_category(spark):
    train = spark.createDataFrame([("credit",), ("debit",)], "card_type string")
    new = spark.createDataFrame([("amex",), ("credit",)], "card_type string")
    from pyspark.ml import PipelineModel

    keep = PipelineModel(stages=PP.fit_label_encoders(train, ["card_type"], "keep"))
    assert [r.card_type for r in keep.transform(new).collect()] == [2, 0]
    strict = PipelineModel(stages=PP.fit_label_encoders(train, ["card_type"], "error"))
    with pytest.raises(Exception):
        strict.transform(new).collect()


def test_defaults_and_json_payloads(spark):
    docs = spark.createDataFrame([('{"Time": 1.0, "Amount": 2.5, "region": "EU"}',), ("not json",)], "payload string")
    p = RC.parse_transactions(docs).collect()
    assert p[0].region == "EU" and p[0].channel == "web" and p[0].card_type == "credit"
    assert p[1]._corrupt is True
    b = spark.createDataFrame([('{"transactions": [{"Amount": 1.0}, {"Amount": 2.0}]}',)], "payload string")
    assert RC.parse_batches(b).count() == 2


def test_one_row_customer_and_fallbacks(spark):
    df = spark.createDataFrame([(1, 10, 0.0, 5.0, 0, 3), (2, 11, 10.0, 15.0, 1, 3)],
                               "transaction_id long, customer_id long, Time double, Amount double, Class int, merchant_id long")
    f = FE.engineer_features(df).orderBy("transaction_id").collect()
    assert f[0].tx_freq_24h == 1 and f[0].avg_amount_per_customer == 5.0
    assert f[1].merchant_fraud_rate == 0.5


def test_trailing_window_bucket_edges(spark):
    # same customer; times straddle day buckets; frame is [t-86400, t]
    times = [0.0, 86399.0, 86400.0, 100000.0, 172800.0, 172800.0, 300000.0]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)], "transaction_id long, customer_id long, Time double")
    got = {r.transaction_id: r.tx_freq_24h for r in FE.trailing_count(df).collect()}
    exp = {i: sum(1 for u in times if t - 86400 <= u <= t) for i, t in enumerate(times)}
    assert got == exp


def test_short_last_chunk(spark):
    df = spark.range(2503).withColumnRenamed("id", "transaction_id")
    sizes = sorted(r[1] for r in WN.chunk_by_position(df, 1000).groupBy("batch_id").count().collect())
    assert sizes == [503, 1000, 1000]


def test_ten_window_split_drops_remainder(spark):
    df = spark.range(1003).select(F.col("id").alias("transaction_id"),
                                  (F.col("id") >= 500).cast("int").alias("prediction"),
                                  F.lit(0.3).alias("fraud_probability"))
    st = DR.window_stats(df, n=1003, n_windows=10).orderBy("window_id").collect()
    assert len(st) == 10 and all(r.n == 100 for r in st)
    alerts = DR.window_drift(DR.window_stats(df, n=1003)).collect()
    assert [a.type for a in alerts] == ["Fraud Rate Drift"] and alerts[0].severity == "HIGH"
    assert alerts[0].message == "Fraud rate changed by 100.00%"
    assert DR.window_stats(df, n=5000).count() == 0  # fewer rows than the buffer


def test_adwin_detects_step_change(spark):
    rows = [(i, float(i * 60), 10.0 + (i % 7) if i < 3000 else 200.0 + (i % 7)) for i in range(6000)]
    df = spark.createDataFrame(rows, "transaction_id long, Time double, Amount double")
    a = DR.adwin_alert(df).collect()
    # found in the grain (32 rows) in which it happens, of which 24 rows are from before
    assert len(a) == 1 and a[0].type == "ADWIN" and a[0].old_value < 14 and a[0].new_value > 50 and a[0].detected_time == 3007 * 60.0
    flat = spark.createDataFrame([(i, float(i * 60), 10.0 + (i % 7)) for i in range(6000)],
                                 "transaction_id long, Time double, Amount double")
    assert DR.adwin_alert(flat).count() == 0


def test_isolation_forest_flags_planted_outliers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    x[:10] += 12.0
    pdf = pd.DataFrame(x, columns=["a", "b", "c", "d"])
    pdf["transaction_id"] = np.arange(2000)
    df = spark.createDataFrame(pdf)
    m = IF.fit(df, ["a", "b", "c", "d"], trees=60)
    s = m.flag(m.score(df)).toPandas().sort_values("score_samples")
    assert set(s.head(10)["transaction_id"]) == set(range(10))
    assert (s[s.transaction_id < 10]["anomaly_flag"] == -1).all()


def test_stream_dedupe_and_late_events(spark, tmp_path):
    from riskframe.streaming import stream as SS

    src = tmp_path / "in"
    schema = "transaction_id long, ts timestamp, Amount double"
    ts = dt.datetime.fromisoformat
    files = [[(1, ts("2024-01-01 10:00"), 5.0), (1, ts("2024-01-01 10:01"), 5.0), (2, ts("2024-01-01 12:00"), 7.0)],
             [(4, ts("2024-01-01 12:30"), 6.0)],
             [(3, ts("2024-01-01 08:00"), 9.0)]]
    for i, rows in enumerate(files):   # one file each, consumed oldest first
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"f{i}"))
    s = SS.file_stream(spark, str(src) + "/*", T._parse_datatype_string(schema), max_files_per_trigger=1)
    d = SS.run_to_table(SS.dedupe(s), "dedupe")
    ids = sorted(r.transaction_id for r in d.collect())
    # id 1 repeated -> kept once; id 3 (08:00) arrives after the watermark
    # (12:00 - 1 h) was established in an earlier batch -> dropped as late
    assert ids == [1, 2, 4]


def test_save_load_round_trips(spark, sf_dir, tmp_path):
    from riskframe.plans import views as V

    t = V.tx(spark, sf_dir)
    pm = PP.fit_preprocessor(t, ["Amount", "Time"])
    PP.save_preprocessor(pm, str(tmp_path / "pre"))
    again = PP.load_preprocessor(str(tmp_path / "pre"))
    a = pm.transform(t).select("transaction_id", "features").orderBy("transaction_id").collect()
    b = again.transform(t).select("transaction_id", "features").orderBy("transaction_id").collect()
    assert a == b
    ml = V.ml(spark, sf_dir)
    m = IF.fit(ml, S.V_COLUMNS[:5], trees=10)
    IF.save(m, spark, str(tmp_path / "if"))
    m2 = IF.load(spark, str(tmp_path / "if"))
    s1 = m.score(ml).select("score_samples").collect()
    s2 = m2.score(ml).select("score_samples").collect()
    assert s1 == s2 and m.offset == m2.offset


def test_sources(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as fh:
        fh.write(",".join(S.raw_transaction_schema().fieldNames()) + "\n")
        fh.write(",".join(["1.0"] + ["0.5"] * 28 + ["9.99", "1"]) + "\n")
    df = TB.read_transactions(spark, path)
    assert df.first().Amount == 9.99 and df.first().Class == 1
    assert TB.read_scored(spark, str(tmp_path / "missing")) is None
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], "p double").write.parquet(empty)
    assert TB.read_scored(spark, empty) is None
    rec = TB.from_records(spark, [{"Time": 1000.0, "Amount": 149.62, "transaction_id": "t1"}])
    assert rec.first().Amount == 149.62 and rec.first().region is None


def test_model_registry_round_trip(spark, sf_dir, tmp_path):
    from riskframe.models import registry as RG
    from riskframe.models import recon as RCN
    from riskframe.plans import views as V

    ml = V.ml(spark, sf_dir)
    pm = PP.fit_preprocessor(ml, S.V_COLUMNS[:6], categorical=[])
    train = PP.with_weights(pm.transform(ml))
    lr = CL.train_logit(train, "logit", max_iter=20)
    rec = RCN.fit(ml, S.V_COLUMNS[:6], k=2)
    iso = IF.fit(ml, S.V_COLUMNS[:6], trees=5)
    lb = spark.createDataFrame([("logit", 0.7, 0.5)], "model string, threshold double, precision double")
    RG.save_models(spark, str(tmp_path / "m"), {"pre": pm, "logit": lr, "recon": rec, "iforest": iso}, lb)
    models, lb2 = RG.load_models(spark, str(tmp_path / "m"))
    assert set(models) == {"pre", "logit", "recon", "iforest"}
    assert RG.thresholds(lb2) == {"logit": 0.7}
    a = lr.transform(train).select("prob_logit").collect()
    b = models["logit"].transform(train).select("prob_logit").collect()
    assert a == b
    assert models["recon"].components == rec.components


def test_prepare_job_fits_on_train_only(spark, sf_dir):
    from riskframe.plans import jobs as J
    from riskframe.plans import views as V

    t = V.tx(spark, sf_dir).drop("ts")
    train, test, pm = J.prepare(t)
    n_tr, n_te = train.count(), test.count()
    assert n_tr + n_te == t.count() and n_te > 0
    assert "features" in train.columns and len(train.first().features) >= 6
    ids = train.select("transaction_id").intersect(test.select("transaction_id")).count()
    assert ids == 0


def test_trailing_count_with_a_hot_key(spark):
    rng = np.random.default_rng(3)
    n = 3000
    cust = np.where(rng.random(n) < 0.4, 7, rng.integers(0, 30, n))   # one customer holds ~40 %
    t = np.round(rng.random(n) * 5 * 86400, 0)
    t[:50] = 86400.0 * 2   # equal times, and exactly one day apart from others
    t[50:80] = 86400.0
    pdf = pd.DataFrame({"transaction_id": np.arange(n), "customer_id": cust, "Time": t})
    df = spark.createDataFrame(pdf)
    a = {r.transaction_id: r.tx_freq_24h for r in FE.trailing_count(df).collect()}
    g = pdf.groupby("customer_id")
    exp = {}
    for _, sub in g:
        tt = sub["Time"].to_numpy()
        for i, ti in zip(sub["transaction_id"], tt):
            exp[i] = int(((tt >= ti - 86400) & (tt <= ti)).sum())
    assert a == exp


def test_page_hinkley_detector_matches_batch_statistic_and_detects_shift(spark):
    from riskframe.operators import drift as DRF
    from riskframe.streaming.state import PageHinkleyDetector

    xs = [0.1] * 400 + [0.9] * 400
    d = PageHinkleyDetector(threshold=20.0, alpha=1.0)
    found = d.update_many(np.array(xs))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "transaction_id long, x double")
    ph = DRF.page_hinkley(df, "x", ["transaction_id"], threshold=20.0, alpha=1.0)
    assert ph.filter("drift").agg(F.min("t")).first()[0] == found[0]
    assert 400 < found[0] < 500
    forgetful = PageHinkleyDetector(threshold=20.0, alpha=0.9)
    forgetful.update_many(np.array(xs))
    assert abs(forgetful.m) < 10  # sums decay instead of growing without bound


def test_stream_adwin_detector_finds_step_change():
    from riskframe.streaming.state import AdwinDetector

    rng = np.random.default_rng(1)
    d = AdwinDetector()
    hits = d.update_many(np.r_[rng.normal(10, 1, 500), rng.normal(20, 1, 500)])
    assert hits and 500 <= hits[0] < 600
    assert d.width() < 600  # what came before the change is gone
    flat = AdwinDetector()
    assert flat.update_many(rng.normal(10, 1, 5000)) == []
    assert flat.width() == 5000 and len(flat.buckets) < 80  # no limit on the window, few buckets


def _event_files(spark, tmp_path, rows):
    schema = "transaction_id long, customer_id long, ts timestamp, fraud_probability double, prediction int"
    for i, chunk in enumerate(rows):
        # one file per chunk: the file source takes files oldest first
        spark.createDataFrame(chunk, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    return T._parse_datatype_string(schema)


def test_stream_sessions_and_sliding_windows(spark, tmp_path):
    from riskframe.streaming import stream as SS

    t0 = dt.datetime(2024, 1, 1, 10, 0)
    m = dt.timedelta(minutes=1)
    rows = [[(1, 1, t0, 0.2, 0), (2, 1, t0 + 10 * m, 0.9, 1), (3, 2, t0 + 5 * m, 0.4, 0)],
            [(4, 1, t0 + 100 * m, 0.3, 0), (5, 2, t0 + 300 * m, 0.1, 0)]]
    schema = _event_files(spark, tmp_path, rows)
    src = SS.file_stream(spark, str(tmp_path / "in") + "/*", schema, max_files_per_trigger=1)
    out = SS.run_to_table(SS.sessions(src), "sess", mode="append").collect()
    # sessions are emitted once the watermark (latest event - 1 h) passes their end:
    # customer 1 has a two-row session (10 min apart, gap 30 min) and a later one;
    # customer 2's last session is still open
    c1 = sorted((r.n, r.max_probability) for r in out if r.customer_id == 1)
    assert c1 == [(1, 0.3), (2, 0.9)]
    assert [r.n for r in out if r.customer_id == 2] == [1]
    src2 = SS.file_stream(spark, str(tmp_path / "in") + "/*", schema, max_files_per_trigger=1)
    slid = SS.run_to_table(SS.windowed_rates(src2, window="1 hour", slide="30 minutes"), "slide",
                           mode="update", keys=["window_start"]).collect()
    by_start = {r.window_start: r.n for r in slid}
    assert by_start["2024-01-01 09:30:00"] == 3 and by_start["2024-01-01 10:00:00"] == 3


def test_processing_time_trigger_loop(spark, tmp_path):
    from riskframe.streaming import stream as SS

    t0 = dt.datetime(2024, 1, 1, 10, 0)
    rows = [[(i, 1, t0, 0.9, 1)] for i in range(4)]
    schema = _event_files(spark, tmp_path, rows)
    src = SS.file_stream(spark, str(tmp_path / "in") + "/*", schema, max_files_per_trigger=1)
    q, out = SS.start(SS.alerts(src), "loop", trigger={"processingTime": "100 milliseconds"})
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.parquet(out)
    assert got.count() == 4 and got.first().message == "High-risk transaction detected: 0.9000"
    assert SS.read_predictions(spark, out, limit=2).count() == 2


def test_live_profiles_use_only_earlier_rows(spark, sf_dir):
    from riskframe.plans.catalog import QUERIES, load_all
    from riskframe.plans import views as V

    load_all()
    got = QUERIES["T5_live_profiles"](spark, sf_dir).toPandas().set_index("transaction_id").sort_index()
    tx = V.tx(spark, sf_dir).select("transaction_id", "customer_id", "Amount").toPandas()
    tx = tx.sort_values("transaction_id")
    tx["cents"] = (tx.Amount * 100).round().astype("int64")
    g = tx.groupby("customer_id")
    tx["n"] = g.cumcount()
    tx["c"] = g["cents"].cumsum() - tx["cents"]
    tx = tx.set_index("transaction_id").sort_index()
    assert (got["profile_tx_count"] == tx["n"]).all()
    exp = (tx["c"] / tx["n"].where(tx["n"] > 0)) / 100.0
    assert np.allclose(got["avg_amount_per_customer"], exp, equal_nan=True)


def test_scoring_raw_rows_through_preprocessing_scorer(spark, sf_dir):
    from riskframe.plans import views as V

    tx = V.tx(spark, sf_dir).drop("ts")
    feats = FE.engineer_features(tx)
    pm = PP.fit_preprocessor(feats, ["Amount", "Time", "avg_amount_per_customer"])
    lr = CL.train_logit(PP.with_weights(pm.transform(feats)), "lr", max_iter=20)
    scorer = CL.model_scorer("lr", lr, preprocessor=pm, prepare_fn=lambda d: FE.engineer_features(d, fit_df=tx))
    preds = CL.score_batch(tx, scorer, name="lr", required=("Time", "Amount"))
    s = R.batch_summary(preds, by=None).first()
    assert s.total_transactions == tx.count()
    assert s.high_risk_count + s.medium_risk_count + s.low_risk_count == s.total_transactions


def test_trained_model_scores_a_stream(spark, sf_dir):
    from riskframe.plans import views as V
    from riskframe.streaming import epochs as EP
    from riskframe.streaming import stream as SS

    hist = V.tx(spark, sf_dir).drop("ts")
    feats = FE.profile_features(hist, hist)
    num = ["Amount", "Time", "avg_amount_per_customer", "tx_freq_24h", "merchant_fraud_rate"]
    pm = PP.fit_preprocessor(feats, num)
    lr = CL.train_logit(PP.with_weights(pm.transform(feats)), "lr", max_iter=20)
    scorer = CL.model_scorer("lr", lr, preprocessor=pm, prepare_fn=lambda d: FE.profile_features(d, hist))
    batch = CL.score_batch(hist, scorer, name="lr", required=("Time", "Amount")).select("transaction_id", "fraud_probability")
    q, log = EP.start_scoring(SS.score_stream(SS.tx_stream(spark, sf_dir), scorer, "lr"), buffer_key=None)
    q.awaitTermination()
    streamed = log.read("predictions")
    assert streamed.count() == hist.count()
    sb = {int(r.transaction_id): r.fraud_probability for r in batch.collect()}
    ss = {int(r.transaction_id): r.fraud_probability for r in streamed.collect()}
    assert sb.keys() == ss.keys()
    assert max(abs(sb[k] - ss[k]) for k in sb) < 1e-12   # stream replay equals batch


def test_page_hinkley_with_forgetting_matches_stream_detector(spark):
    from riskframe.operators import drift as DRF
    from riskframe.operators import prefix as PF
    from riskframe.streaming.state import PageHinkleyDetector

    rng = np.random.default_rng(5)
    xs = np.r_[rng.normal(0.2, 0.05, 1500), rng.normal(0.8, 0.05, 1500)]
    alpha = 0.999
    # by hand, value by value, without a reset
    n = total = m = u = 0
    min_m = min_u = np.inf
    ms, flags = [], []
    for x in xs:
        n, total = n + 1, total + x
        m, u = alpha * m + x - total / n - 0.005, alpha * u + total / n - x - 0.005
        min_m, min_u = min(min_m, m), min(min_u, u)
        ms.append(m)
        flags.append(n >= 30 and (m - min_m > 5.0 or u - min_u > 5.0))
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "transaction_id long, x double")
    ph = DRF.page_hinkley(df, "x", ["transaction_id"], threshold=5.0, alpha=alpha).orderBy("t").toPandas()
    assert np.allclose(ph["ph_m"].to_numpy(), ms, atol=1e-9)
    assert ph["drift"].tolist() == flags
    d = PageHinkleyDetector(threshold=5.0, alpha=alpha)
    assert d.update_many(xs)[0] == flags.index(True) + 1
    # however the values are cut into micro-batches
    e, found = PageHinkleyDetector(threshold=5.0, alpha=alpha), []
    for part in np.array_split(xs, 37):
        again = PageHinkleyDetector(threshold=5.0, alpha=alpha)
        again.from_numbers(e.numbers())
        found += again.update_many(part)
        e = again
    assert found == PageHinkleyDetector(threshold=5.0, alpha=alpha).update_many(xs)
    # the affine scan equals a sequential loop across many range partitions
    v = rng.normal(size=5000)
    vd = spark.createDataFrame([(i, float(a)) for i, a in enumerate(v)], "id long, v double")
    got = PF.decayed_running(vd, ["id"], {"m": "v"}, 0.9, partitions=7).orderBy("id").toPandas()["m"].to_numpy()
    exp, m = [], 0.0
    for a in v:
        m = 0.9 * m + a
        exp.append(m)
    assert np.allclose(got, exp, atol=1e-9)
