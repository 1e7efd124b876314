"""Registered queries: scalar function suite, alignment, pluggable scorer,
composed reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions import scalars as X
from riskframe.models import classifiers as CL
from riskframe.operators import evaluate as EV
from riskframe.operators import features as FE
from riskframe.operators import report as R
from riskframe.plans import jobs as J
from riskframe.plans import queries_core, queries_profile  # noqa: F401  their oracles are parts of the jobs'
from riskframe.plans import views as V
from riskframe.plans.catalog import ORACLE, register
from riskframe.plans.oracle import sql
from riskframe.plans.queries_report import stand_in_models


def _scalars(spark, d):
    s = V.scored(spark, d)
    lo, hi = s.agg(F.min("Amount")).scalar(), s.agg(F.max("Amount")).scalar()
    p = F.col("fraud_probability")
    return s.select(
        "transaction_id",
        X.hour_of_day("Time").alias("hour_s"), X.hour_of_day("Time", "reference").alias("hour_ref"),
        X.day_of_week("Time").alias("dow_s"), X.day_of_week("Time", "reference").alias("dow_ref"),
        X.risk_band(p).alias("band"),
        X.anomaly_flag_to_probability(F.when(F.col("transaction_type") == "error", -1).otherwise(1)).alias("flag_p"),
        X.threshold_classify(p, 0.5).alias("cls_ge"), X.threshold_classify(p, 0.5, strict=True).alias("cls_gt"),
        X.minmax_normalise("Amount", lo, hi).alias("amount_norm"),
        X.minmax_normalise("Amount", lo, hi, invert=True).alias("amount_inv"),
        X.weighted_score([p, F.lit(0.5), F.lit(1.0)]).alias("weighted"),
        X.safe_ratio("Amount", F.pmod("customer_id", F.lit(3))).alias("ratio"),
        X.merchant_status(p).alias("status"),
        X.drift_severity(F.abs(p - 0.5)).alias("severity"),
        X.fmt4(p).alias("p4"), X.fmt_pct2(p).alias("p_pct"),
        X.default_tx_id(F.when(F.col("Class") == 1, F.lit(None)).otherwise(F.col("transaction_id")),
                        F.col("transaction_id")).alias("tx_id"),
        X.category_text("card_type").alias("card_text"), X.round3("Amount").alias("amount3"))


register("F1_F15_scalar_functions", sql("scored", """mm AS (SELECT min("Amount") AS lo, max("Amount") AS hi FROM scored)""",
                                       body="""SELECT transaction_id,
  CAST(floor("Time" / 3600.0) % 24 AS INTEGER) AS hour_s, CAST(floor("Time") % 24 AS INTEGER) AS hour_ref,
  CAST(floor("Time" / 86400.0) % 7 AS INTEGER) AS dow_s, CAST(floor("Time" / 24.0) % 7 AS INTEGER) AS dow_ref,
  CASE WHEN fraud_probability > 0.8 THEN 'High' WHEN fraud_probability > 0.5 THEN 'Medium' ELSE 'Low' END AS band,
  CASE WHEN transaction_type = 'error' THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS flag_p,
  CAST(fraud_probability >= 0.5 AS INTEGER) AS cls_ge, CAST(fraud_probability > 0.5 AS INTEGER) AS cls_gt,
  ("Amount" - lo) / nullif(hi - lo, 0.0) AS amount_norm, 1.0::DOUBLE - ("Amount" - lo) / nullif(hi - lo, 0.0) AS amount_inv,
  fraud_probability * 0.5::DOUBLE + 0.5::DOUBLE * 0.3::DOUBLE + 1.0::DOUBLE * 0.2::DOUBLE AS weighted,
  coalesce(CASE WHEN customer_id % 3 = 0 THEN NULL ELSE "Amount" / CAST(customer_id % 3 AS DOUBLE) END, 0.0) AS ratio,
  CASE WHEN fraud_probability >= 0.7 THEN 'Review' WHEN fraud_probability >= 0.6 THEN 'Monitor' ELSE 'Normal' END AS status,
  CASE WHEN abs(fraud_probability - 0.5) > 0.2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CAST(CAST(round(CAST(fraud_probability AS DECIMAL(38,10)), 4) AS DECIMAL(38,4)) AS VARCHAR) AS p4,
  CAST(CAST(round(CAST(fraud_probability * 100.0 AS DECIMAL(38,10)), 2) AS DECIMAL(38,2)) AS VARCHAR) || '%' AS p_pct,
  CASE WHEN "Class" = 1 THEN 'tx_' || CAST(transaction_id AS VARCHAR) ELSE CAST(transaction_id AS VARCHAR) END AS tx_id,
  coalesce(card_type, 'nan') AS card_text, round("Amount", 3) AS amount3
FROM scored, mm"""))(_scalars)

register("J4_align_predictions", sql("scored", body="""SELECT p.transaction_id, p.fraud_probability, t."Class"
FROM (SELECT transaction_id, fraud_probability FROM scored WHERE transaction_type <> 'view') p
JOIN (SELECT transaction_id, "Class" FROM tx WHERE transaction_type <> 'click') t ON p.transaction_id = t.transaction_id"""))(
    lambda spark, d: FE.align_on_id(
        V.scored(spark, d).filter(F.col("transaction_type") != "view").select("transaction_id", "fraud_probability"),
        V.tx(spark, d).filter(F.col("transaction_type") != "click").select("transaction_id", "Class")))


@F.pandas_udf(T.DoubleType())
def _amount_scorer(amount: pd.Series) -> pd.Series:
    """A vectorised (Arrow batch) scorer, registered through X1."""
    return pd.Series(np.round(1.0 - np.exp(-amount.to_numpy(dtype="float64") / 50.0), 6))


def _x1(spark, d):
    CL.register_scorer("amount_udf", CL.udf_scorer("amount_udf", _amount_scorer, ["Amount"]))
    return CL.score_batch(V.tx(spark, d), "amount_udf", required=("Time", "Amount")).drop("error", "prediction_time")


register("X1_pluggable_scorer", sql("tx", body="""SELECT CAST(transaction_id AS VARCHAR) AS transaction_id,
  round(1.0 - exp(-"Amount" / 50.0), 6) AS fraud_probability,
  CASE WHEN round(1.0 - exp(-"Amount" / 50.0), 6) > 0.8 THEN 'High'
       WHEN round(1.0 - exp(-"Amount" / 50.0), 6) > 0.5 THEN 'Medium' ELSE 'Low' END AS risk_level,
  'amount_udf' AS model_used FROM tx"""))(_x1)


# ---- whole jobs: every section of the job's result, unpivoted ----------------

def _long(sections: dict) -> DataFrame:
    """(section, key, metric, value) rows of frames: text columns and the named
    keys make the key, the other columns are metrics."""
    parts = []
    for name, (df, keys) in sections.items():
        metrics = [c for c in df.columns if c not in keys]
        key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]) if keys else F.lit("all")
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        parts.append(df.select(F.lit(name).alias("section"), key.alias("key"), F.explode(pairs).alias("x"))
                     .select("section", "key", "x.*"))
    return R.union_all(parts)


def _long_sql(sections: dict) -> str:
    parts = []
    for name, (query, keys, metrics) in sections.items():
        text = ORACLE.get(query, query)
        key = "concat_ws('|', " + ", ".join(f"coalesce(CAST(\"{k}\" AS VARCHAR), 'null')" for k in keys) + ")" if keys else "'all'"
        parts += [f"SELECT '{name}' AS section, {key} AS key, '{m}' AS metric, CAST(\"{m}\" AS DOUBLE) AS value FROM ({text}) AS q"
                  for m in metrics]
    return "\nUNION ALL ".join(parts)


_BOX = ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high", "outliers"]
_DESCRIBE = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
_SUMMARY = ["rows", "normal_count", "fraud_count", "fraud_rate_pct", "amount_mean", "amount_std", "amount_min", "amount_max", "amount_median"]
_HIST = ["lower", "upper", "n"]
_TX_COLUMNS = ["transaction_id", "Time", "Amount", "customer_id", "merchant_id", "transaction_type", "card_type", "region",
               "channel", "Class"]


def _c1(spark, d):
    p = J.profile(V.tx(spark, d).drop("ts"), numeric=["Time", "Amount", "Class"])
    return _long({"nulls": (p["nulls"], ["column_name"]), "summary": (p["summary"].select(*_SUMMARY), []),
                  "class_counts": (p["class_counts"], ["value"]), "class_balance": (p["class_balance"], ["class_name"]),
                  "amount_hist": (p["amount_hist"], ["bin"]), "time_hist": (p["time_hist"], ["bin"]),
                  "amount_box": (p["amount_box"], ["Class"]), "correlation": (p["correlation"], ["col_a", "col_b"])})


_NULLS = sql("tx", body="\nUNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE "{c}" IS NULL) AS null_count FROM tx""" for c in _TX_COLUMNS))
_CORR = sql("tx", body="\nUNION ALL ".join(
    f"""SELECT '{a}' AS col_a, '{b}' AS col_b, """ + ("1.0::DOUBLE" if a == b else
                                                      f"""round(corr(CAST("{a}" AS DOUBLE), CAST("{b}" AS DOUBLE)), 6)""") + " AS corr FROM tx" for a in ("Time", "Amount", "Class") for b in ("Time", "Amount", "Class") if a != b)
    + "".join(f"\nUNION ALL SELECT '{a}', '{a}', 1.0::DOUBLE" for a in ("Time", "Amount", "Class")))

register("C1_profile", _long_sql({
    "nulls": (_NULLS, ["column_name"], ["null_count"]), "summary": ("A1_dataset_summary", [], _SUMMARY),
    "class_counts": (sql("tx", body="""SELECT "Class" AS value, count(*) AS n FROM tx GROUP BY 1"""), ["value"], ["n"]), "class_balance": ("A22_class_balance", ["class_name"], ["n"]),
    "amount_hist": ("A11_histogram_amount", ["bin"], _HIST), "time_hist": ("A11_histogram_time", ["bin"], _HIST),
    "amount_box": ("A12_box_amount_by_class", ["Class"], _BOX), "correlation": (_CORR, ["col_a", "col_b"], ["corr"])}))(_c1)


def _c2(spark, d):
    t = FE.time_features(V.tx(spark, d))
    c = J.characteristics(FE.attach(t, FE.merchant_profile(t), "merchant_id"))
    return _long({"distinct": (c["distinct"], []), "group_sizes": (c["group_sizes"], ["grouping"]), "time_span": (c["time_span"], []),
                  "activity": (c["activity"], ["dimension", "value"]), "group_rates": (c["group_rates"], ["grouping"]),
                  "merchant_rate_box": (c["merchant_rate_box"], ["Class"])})


register("C2_characteristics", _long_sql({
    "distinct": ("A5_distinct_counts", [], ["distinct_customer_id", "distinct_merchant_id"]),
    "group_sizes": ("A6_group_size_describe", ["grouping"], _DESCRIBE), "time_span": ("A8_time_span_days", [], ["time_span_days"]),
    "activity": ("A18_activity_counts", ["dimension", "value"], ["n"]),
    "group_rates": ("A7_group_rate_describe", ["grouping"], _DESCRIBE),
    "merchant_rate_box": ("A12_box_merchant_rate_by_class", ["Class"], _BOX)}))(_c2)

_BANDS = ["total_transactions", "high_risk_count", "medium_risk_count", "low_risk_count", "fraud_rate"]


def _c5(spark, d):
    """C5 whole: scoring, batches, roll-up and the alert log (day of the week watched)."""
    t = V.tx(spark, d).withColumn("day", F.weekday("ts"))
    h = J.score_history(t, lambda df: df.withColumn("p_amount50", V.stand_in_probability()), "amount50",
                        required=("Time", "Amount"), watch="day")
    preds = h["predictions"].groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"), X.exact_sum("fraud_probability").alias("total"))
    return _long({"predictions": (preds, ["risk_level"]), "batches": (h["batches"], ["batch_id"]), "rollup": (h["rollup"], []),
                  "alerts": (h["alerts"].select("type", "severity", "old_value", "new_value"), ["type", "severity"])})


_C5_ROLLUP = f"""SELECT count(*) AS batches, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _BANDS[:4])},
  sum(high_risk_count) / sum(total_transactions) AS fraud_rate FROM ({ORACLE["C5_score_history"]}) AS b"""
_C5_ALERTS = f"""SELECT type, severity, old_value, new_value FROM ({ORACLE["D1_adwin_alert"]}) AS a
UNION ALL SELECT type, severity, old_value, new_value FROM ({ORACLE["D3_D4_window_drift"].replace("chg > 0.001", "chg > 0.1")}) AS w"""
register("C5_score_history_job", _long_sql({
    "predictions": (sql("banded", body="""SELECT risk_level, count(*) AS n,
  CAST(sum(CAST(fraud_probability AS DECIMAL(38,6))) AS DOUBLE) AS total FROM banded GROUP BY 1"""), ["risk_level"], ["n", "total"]),
    "batches": ("C5_score_history", ["batch_id"], _BANDS), "rollup": (_C5_ROLLUP, [], ["batches", *_BANDS]),
    "alerts": (_C5_ALERTS, ["type", "severity"], ["old_value", "new_value"])}))(_c5)


def _c7(spark, d):
    s = V.scored(spark, d)
    r = J.risk_report(s, EV.leaderboard(s, stand_in_models()))
    quartiles = r["quartiles"].groupBy("risk_quartile").agg(F.count(F.lit(1)).alias("n"))
    merchant = ["merchant_id", "status"]
    return _long({"kpis": (r["kpis"], []), "by_hour": (r["by_hour"], ["hour_of_day"]), "by_type": (r["by_type"], ["transaction_type"]),
                  "amount_buckets": (r["amount_buckets"], ["amount_range"]), "activity": (r["activity"], ["dimension", "value"]),
                  "merchants": (r["merchants"], merchant), "overview": (r["merchant_overview"], []),
                  "top_merchants": (r["top_merchants"], merchant), "daily_volume": (r["daily_volume"], ["day"]),
                  "quartiles": (quartiles, ["risk_quartile"]),
                  "high_risk": (r["high_risk"].select("transaction_id", "fraud_probability", "Amount"), ["transaction_id"])})


_MERCHANT = (["merchant_id", "status"], ["risk_score", "transactions", "fraud_rate"])
register("C7_risk_report", _long_sql({
    "kpis": ("A16_kpis", [], ["total_transactions", "fraud_rate_pct", "precision", "recall"]),
    "by_hour": ("A9_risk_by_hour", ["hour_of_day"], ["avg_risk_score", "fraud_count"]),
    "by_type": ("A10_risk_by_type", ["transaction_type"], ["avg_risk_score", "fraud_count"]),
    "amount_buckets": ("A17_amount_buckets", ["amount_range"], ["n"]), "activity": ("A18_activity_counts", ["dimension", "value"], ["n"]),
    "merchants": ("A19_merchant_risk", *_MERCHANT),
    "overview": ("A19_merchant_overview", [], ["merchants", "high_risk_merchants", "avg_risk_score"]),
    "top_merchants": ("K6_top_risk_merchants", *_MERCHANT),
    "daily_volume": ("A20_daily_volume", ["day"], ["volume", "avg_amount", "peak_hour", "blocked_amount"]),
    "quartiles": ("W8_quartile_labels", ["risk_quartile"], ["n"]),
    "high_risk": ("K1_high_risk_top10", ["transaction_id"], ["fraud_probability", "Amount"])}))(_c7)
