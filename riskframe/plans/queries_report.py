"""Registered queries: scored-table analytics, evaluation, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import scalars as X
from riskframe.operators import drift as DR
from riskframe.operators import evaluate as EV
from riskframe.operators import features as FE
from riskframe.operators import report as R
from riskframe.operators import stats as ST
from riskframe.operators import windows as WN
from riskframe.plans import views as V
from riskframe.plans.catalog import register
from riskframe.plans.oracle import sql

EXACT_AVG = 'CAST(sum(CAST({x} AS DECIMAL(38,{s}))) AS DOUBLE) / count({x})'


def _xavg(x, s):
    return EXACT_AVG.format(x=x, s=s)


def stand_in_models():
    """Three deterministic scorers over ``scored`` (stand-ins for trained
    models, so evaluation has exact oracles)."""
    return {"amount50": F.col("fraud_probability"),
            "amount100": F.round(F.lit(1.0) - F.exp(-F.col("Amount") / 100.0), 6),
            "type_flag": X.anomaly_flag_to_probability(
                F.when(F.col("transaction_type") == "error", F.lit(-1)).otherwise(F.lit(1)))}


MODELS_SQL = """s AS (
  SELECT 'amount50' AS model, fraud_probability AS score, "Class" AS label FROM scored
  UNION ALL SELECT 'amount100', round(1.0 - exp(-"Amount" / 100.0), 6), "Class" FROM scored
  UNION ALL SELECT 'type_flag', CASE WHEN transaction_type = 'error' THEN 0.9 ELSE 0.1 END, "Class" FROM scored)"""
CURVE_SQL = [MODELS_SQL, """c AS (
  SELECT model, score, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg
  FROM s WHERE score IS NOT NULL GROUP BY model, score)""", """cu AS (
  SELECT model, score, pos, neg,
    CAST(sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS BIGINT) AS tp,
    CAST(sum(neg) OVER (PARTITION BY model ORDER BY score DESC) AS BIGINT) AS fp,
    CAST(sum(pos) OVER (PARTITION BY model) AS BIGINT) AS "P",
    CAST(sum(neg) OVER (PARTITION BY model) AS BIGINT) AS "N"
  FROM c)""", """pr AS (
  SELECT model, score AS threshold, tp, fp,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision,
    CASE WHEN "P" > 0 THEN tp / "P" ELSE 1.0::DOUBLE END AS recall
  FROM cu)""", """g AS (
  SELECT model, min(threshold) FILTER (WHERE precision >= 0.9) AS hit, max(threshold) AS mx,
         min(threshold) AS mn FROM pr GROUP BY model)""", """thr AS (SELECT model, coalesce(hit, mx) AS threshold FROM g)""",
              """conf AS (
  SELECT s.model, thr.threshold,
    count(*) FILTER (WHERE score >= thr.threshold AND label = 1) AS tp,
    count(*) FILTER (WHERE score >= thr.threshold AND label = 0) AS fp,
    count(*) FILTER (WHERE NOT coalesce(score >= thr.threshold, false) AND label = 1) AS fn,
    count(*) FILTER (WHERE NOT coalesce(score >= thr.threshold, false) AND label = 0) AS tn
  FROM s JOIN thr ON s.model = thr.model GROUP BY s.model, thr.threshold)""",
              """auc AS (
  SELECT model, CASE WHEN "P" > 0 AND "N" > 0 THEN
      CAST(sum(2 * pos * ("N" - fp) + pos * neg) AS DOUBLE) / (2.0::DOUBLE * "P" * "N") END AS auc
  FROM cu GROUP BY model, "P", "N")"""]


def _scores(spark, d):
    return EV.long_scores(V.scored(spark, d), stand_in_models())


def _pr(spark, d):
    return EV.pr_curve(_scores(spark, d))


register("E1_pr_curve", sql("scored", *CURVE_SQL[:4], body="SELECT * FROM pr"))(_pr)

register("E2_threshold_for_precision", sql("scored", *CURVE_SQL[:5], """b AS (
  SELECT pr.model, max(threshold) AS below FROM pr JOIN g ON pr.model = g.model
  WHERE threshold < hit GROUP BY pr.model)""", body="""SELECT model, 'exact' AS mode, coalesce(hit, mx) AS threshold FROM g
UNION ALL
SELECT g.model, 'reference', CASE WHEN hit IS NULL THEN mx WHEN hit = mn THEN 0.5 ELSE below END
FROM g LEFT JOIN b ON g.model = b.model"""))(
    lambda spark, d: (lambda pr: EV.threshold_for_precision(pr, 0.9, "exact").withColumn("mode", F.lit("exact"))
                      .unionByName(EV.threshold_for_precision(pr, 0.9, "reference").withColumn("mode", F.lit("reference"))))
    (_pr(spark, d).cache()))

register("E3_auc", sql("scored", *CURVE_SQL[:3], CURVE_SQL[7], body="SELECT * FROM auc"))(
    lambda spark, d: EV.auc(_scores(spark, d)))

register("E4_roc_curve", sql("scored", *CURVE_SQL[:3], body="""SELECT model, score AS threshold,
  CASE WHEN "N" > 0 THEN fp / "N" END AS fpr, CASE WHEN "P" > 0 THEN tp / "P" END AS tpr FROM cu"""))(
    lambda spark, d: EV.roc_curve(_scores(spark, d)))

_REPORT_SQL = """b AS (SELECT model,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS p1,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS r1,
    CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0::DOUBLE END AS p0,
    CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0::DOUBLE END AS r0,
    CAST(tp + fn AS DOUBLE) AS s1, CAST(tn + fp AS DOUBLE) AS s0, CAST(tp + fp + fn + tn AS DOUBLE) AS n,
    CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0.0::DOUBLE END AS acc
  FROM conf)""", """f AS (SELECT *,
    CASE WHEN p1 + r1 > 0 THEN 2.0::DOUBLE * p1 * r1 / (p1 + r1) ELSE 0.0::DOUBLE END AS f1,
    CASE WHEN p0 + r0 > 0 THEN 2.0::DOUBLE * p0 * r0 / (p0 + r0) ELSE 0.0::DOUBLE END AS f0 FROM b)"""

register("E5_classification_report", sql("scored", *CURVE_SQL[:7], *_REPORT_SQL, body="""
SELECT model, '0' AS class_label, p0 AS precision, r0 AS recall, f0 AS f1_score, CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT model, '1', p1, r1, f1, CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT model, 'accuracy', acc, acc, acc, CAST(n AS BIGINT) FROM f
UNION ALL SELECT model, 'macro avg', (p0 + p1) / 2.0::DOUBLE, (r0 + r1) / 2.0::DOUBLE, (f0 + f1) / 2.0::DOUBLE, CAST(n AS BIGINT) FROM f
UNION ALL SELECT model, 'weighted avg',
  CASE WHEN n > 0 THEN (p0 * s0 + p1 * s1) / n ELSE 0.0::DOUBLE END,
  CASE WHEN n > 0 THEN (r0 * s0 + r1 * s1) / n ELSE 0.0::DOUBLE END,
  CASE WHEN n > 0 THEN (f0 * s0 + f1 * s1) / n ELSE 0.0::DOUBLE END, CAST(n AS BIGINT) FROM f"""))(
    lambda spark, d: (lambda s: EV.classification_report(
        EV.confusion(s, EV.threshold_for_precision(EV.pr_curve(s), 0.9))))(_scores(spark, d).cache()))

_LB_SQL = sql("scored", *CURVE_SQL, """lb AS (
  SELECT conf.model, threshold,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall,
    CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0.0::DOUBLE END AS accuracy,
    auc.auc,
    CASE conf.model WHEN 'amount50' THEN 0 WHEN 'amount100' THEN 1 ELSE 2 END AS model_order
  FROM conf LEFT JOIN auc ON conf.model = auc.model)""", """lbf AS (SELECT *,
  CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1_score
  FROM lb)""", body="{body}")


def _leaderboard(spark, d):
    return EV.leaderboard(V.scored(spark, d), stand_in_models())


register("E6_leaderboard", _LB_SQL.format(body="SELECT * FROM lbf"))(_leaderboard)
register("K4_best_model", _LB_SQL.format(body="""SELECT model, precision, recall FROM lbf
ORDER BY precision DESC, model_order, model LIMIT 1"""))(
    lambda spark, d: R.best_model(_leaderboard(spark, d)).select("model", "precision", "recall"))
register("A16_kpis", _LB_SQL.format(body="""SELECT (SELECT count(*) FROM scored) AS total_transactions,
  (SELECT sum("Class") / count(*) * 100.0 FROM scored) AS fraud_rate_pct, precision, recall
FROM lbf ORDER BY precision DESC, model_order, model LIMIT 1"""))(
    lambda spark, d: R.kpis(V.scored(spark, d), _leaderboard(spark, d)))

# ---- breakdowns and reports -------------------------------------------------

register("A9_risk_by_hour", sql("scored", body=f"""SELECT CAST(floor("Time" / 3600.0) % 24 AS INTEGER) AS hour_of_day,
  {_xavg('fraud_probability', 6)} AS avg_risk_score, CAST(sum("Class") AS BIGINT) AS fraud_count
FROM scored GROUP BY 1"""))(
    lambda spark, d: R.risk_by(FE.time_features(V.scored(spark, d)), "hour_of_day"))

register("A10_risk_by_type", sql("scored", body=f"""SELECT transaction_type,
  {_xavg('fraud_probability', 6)} AS avg_risk_score, CAST(sum("Class") AS BIGINT) AS fraud_count
FROM scored GROUP BY 1"""))(lambda spark, d: R.risk_by(V.scored(spark, d), "transaction_type"))

register("A14_daily_batch_summary", sql("banded", body="""SELECT strftime(ts, '%Y-%m-%d') AS batch_id,
  count(*) AS total_transactions,
  count(*) FILTER (WHERE risk_level = 'High') AS high_risk_count,
  count(*) FILTER (WHERE risk_level = 'Medium') AS medium_risk_count,
  count(*) FILTER (WHERE risk_level = 'Low') AS low_risk_count,
  count(*) FILTER (WHERE risk_level = 'High') / count(*) AS fraud_rate
FROM banded GROUP BY 1"""))(
    lambda spark, d: R.batch_summary(R.with_band(V.scored(spark, d)).withColumn(
        "batch_id", F.date_format("ts", "yyyy-MM-dd")), by="batch_id"))


def _rollup(spark, d):
    from riskframe.plans.queries_core import score_history

    return R.rollup_batches(score_history(spark, d))


register("A15_rollup_batches", sql("banded", body="""SELECT CAST(ceil(count(*) / 1000.0) AS BIGINT) AS batches,
  count(*) AS total_transactions,
  count(*) FILTER (WHERE risk_level = 'High') AS high_risk_count,
  count(*) FILTER (WHERE risk_level = 'Medium') AS medium_risk_count,
  count(*) FILTER (WHERE risk_level = 'Low') AS low_risk_count,
  count(*) FILTER (WHERE risk_level = 'High') / count(*) AS fraud_rate
FROM banded"""))(_rollup)

register("A17_amount_buckets", sql("tx", body="""SELECT CASE WHEN "Amount" < 50 THEN '0-50' WHEN "Amount" < 100 THEN '50-100'
  WHEN "Amount" < 200 THEN '100-200' WHEN "Amount" < 500 THEN '200-500' ELSE '500+' END AS amount_range,
  count(*) AS n FROM tx GROUP BY 1"""))(lambda spark, d: R.amount_buckets(V.tx(spark, d)))

_DIMS = ["hour_of_day", "day_of_week", "transaction_type", "card_type", "region", "channel"]
register("A18_activity_counts", sql("tx", """t AS (SELECT *, CAST(floor("Time" / 3600.0) % 24 AS INTEGER) AS hour_of_day,
  CAST(floor("Time" / 86400.0) % 7 AS INTEGER) AS day_of_week FROM tx)""", body="\nUNION ALL ".join(
    f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM t GROUP BY {c}" for c in _DIMS)))(
    lambda spark, d: R.activity_counts(FE.time_features(V.tx(spark, d))))

_MERCH_SQL = f"""m AS (SELECT merchant_id, {_xavg('fraud_probability', 6)} AS risk_score, count(*) AS transactions,
  avg(CAST("Class" AS DOUBLE)) AS fraud_rate FROM scored GROUP BY merchant_id)"""
register("A19_merchant_risk", sql("scored", _MERCH_SQL, body="""SELECT *, CASE WHEN risk_score >= 0.7 THEN 'Review'
  WHEN risk_score >= 0.6 THEN 'Monitor' ELSE 'Normal' END AS status FROM m"""))(
    lambda spark, d: R.merchant_risk(V.scored(spark, d)))
register("A19_merchant_overview", sql("scored", _MERCH_SQL, body="""SELECT count(*) AS merchants,
  count(*) FILTER (WHERE risk_score >= 0.7) AS high_risk_merchants, round(avg(risk_score), 6) AS avg_risk_score FROM m"""))(
    lambda spark, d: R.merchant_overview(R.merchant_risk(V.scored(spark, d))))
register("K6_top_risk_merchants", sql("scored", _MERCH_SQL, body="""SELECT *, CASE WHEN risk_score >= 0.7 THEN 'Review'
  WHEN risk_score >= 0.6 THEN 'Monitor' ELSE 'Normal' END AS status FROM m ORDER BY risk_score DESC, merchant_id LIMIT 5"""))(
    lambda spark, d: R.top_risk_merchants(R.merchant_risk(V.scored(spark, d)), 5))
register("K6_top_per_region", sql("scored", body="""SELECT region, transaction_id, fraud_probability FROM (
  SELECT region, transaction_id, fraud_probability,
    row_number() OVER (PARTITION BY region ORDER BY fraud_probability DESC, transaction_id) AS r FROM scored) WHERE r <= 3"""))(
    lambda spark, d: R.top_per_group(V.scored(spark, d).select("region", "transaction_id", "fraud_probability"),
                                     "region", "fraud_probability", 3, "transaction_id"))

register("A20_daily_volume", sql("scored", """h AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) AS INTEGER) AS hour,
  count(*) AS hn, sum(CAST("Amount" AS DECIMAL(38,2))) AS ha,
  sum(CASE WHEN fraud_probability >= 0.5 THEN CAST("Amount" AS DECIMAL(38,2)) ELSE 0 END) AS hb
  FROM scored GROUP BY 1, 2)""", body="""SELECT day, CAST(sum(hn) AS BIGINT) AS volume, CAST(sum(ha) AS DOUBLE) / sum(hn) AS avg_amount,
  arg_min(hour, (-hn, hour)) AS peak_hour, CAST(sum(hb) AS DOUBLE) AS blocked_amount FROM h GROUP BY day"""))(
    lambda spark, d: R.daily_volume(V.scored(spark, d)))

register("A21_running_totals", sql("scored", body="""SELECT count(*) AS total_transactions,
  CAST(count(*) FILTER (WHERE fraud_probability >= 0.5) AS BIGINT) AS fraud_detected,
  round(count(*) FILTER (WHERE fraud_probability >= 0.5) / count(*) * 100.0, 3) AS fraud_rate_pct FROM scored"""))(
    lambda spark, d: R.running_totals(V.scored(spark, d).withColumn(
        "prediction", X.threshold_classify("fraud_probability", 0.5))))

register("K1_high_risk_top10", sql("scored", body="""SELECT transaction_id, fraud_probability, "Amount" FROM scored
WHERE fraud_probability > 0.7 ORDER BY fraud_probability DESC, transaction_id LIMIT 10"""))(
    lambda spark, d: R.high_risk_rows(V.scored(spark, d)).select("transaction_id", "fraud_probability", "Amount"))

register("K2_recent_log", """SELECT event_id, user_id, event_type, (SELECT count(*) FROM events) AS total_events
FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""")(
    lambda spark, d: (lambda ev: ev.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100)
                      .select("event_id", "user_id", "event_type",
                              ev.select(F.count(F.lit(1))).scalar().alias("total_events")))
    (V.table(spark, d, "events", "event_id", "ts", "user_id", "event_type")))

register("K3_recent_transactions", sql("scored", body="""SELECT transaction_id, "Amount", fraud_probability FROM scored
ORDER BY ts DESC, transaction_id DESC LIMIT 50"""))(
    lambda spark, d: V.scored(spark, d).orderBy(F.col("ts").desc(), F.col("transaction_id").desc()).limit(50)
    .select("transaction_id", "Amount", "fraud_probability"))


def _p95(spark, d):
    s = V.scored(spark, d)
    cut = ST.exact_quantiles(s, "fraud_probability", [0.95], tiebreak="transaction_id").select("q_95").scalar()
    return s.filter(F.col("fraud_probability") > cut).select("transaction_id", "fraud_probability")


register("K5_above_p95", sql("scored", body="""SELECT transaction_id, fraud_probability FROM scored
WHERE fraud_probability > (SELECT quantile_cont(fraud_probability, 0.95) FROM scored)"""))(_p95)

register("U1_union_bands", sql("banded", body="""SELECT transaction_id, risk_level, fraud_probability, NULL::VARCHAR AS note FROM banded WHERE risk_level = 'High'
UNION ALL SELECT transaction_id, risk_level, NULL::DOUBLE, 'medium' FROM banded WHERE risk_level = 'Medium'"""))(
    lambda spark, d: (lambda b: R.union_all([
        b.filter(F.col("risk_level") == "High").select("transaction_id", "risk_level", "fraud_probability"),
        b.filter(F.col("risk_level") == "Medium").select("transaction_id", "risk_level", F.lit("medium").alias("note"))]))
    (R.with_band(V.scored(spark, d))))

# ---- windows ---------------------------------------------------------------

register("W3_last_n", sql("scored", body="""SELECT transaction_id, fraud_probability FROM scored
ORDER BY transaction_id DESC LIMIT 1000"""))(
    lambda spark, d: WN.last_n(V.scored(spark, d).select("transaction_id", "fraud_probability"), 1000))

_WIN_SQL = """r AS (SELECT transaction_id, fraud_probability, CAST(fraud_probability >= 0.5 AS INTEGER) AS prediction
  FROM scored ORDER BY transaction_id DESC LIMIT 1000)""", """w AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY transaction_id) - 1)
  / floor((SELECT count(*) FROM r) / 10)) AS INTEGER) AS window_id FROM r)""", f"""ws AS (SELECT window_id,
  avg(CAST(prediction = 1 AS DOUBLE)) AS fraud_rate, {_xavg('fraud_probability', 6)} AS avg_probability,
  count(*) AS n FROM w WHERE window_id < 10 GROUP BY window_id)"""


def _wstats(spark, d):
    s = V.scored(spark, d).withColumn("prediction", X.threshold_classify("fraud_probability", 0.5))
    return DR.window_stats(s, 1000, 10)


register("W4_window_split", sql("scored", *_WIN_SQL, body="SELECT * FROM ws"))(_wstats)

register("W5_chunk_positions", sql("tx", body="""SELECT transaction_id,
  (row_number() OVER (ORDER BY transaction_id) - 1) // 1000 AS batch_id FROM tx"""))(
    lambda spark, d: WN.chunk_by_position(V.tx(spark, d).select("transaction_id"), 1000))

register("W6_cumulative_accuracy", sql("scored", body="""SELECT transaction_id,
  sum(CAST((fraud_probability > 0.5) = ("Class" = 1) AS INTEGER)) OVER (ORDER BY transaction_id ROWS UNBOUNDED PRECEDING)
  / count(*) OVER (ORDER BY transaction_id ROWS UNBOUNDED PRECEDING) AS cumulative_accuracy FROM scored"""))(
    lambda spark, d: WN.cumulative_mean(
        V.scored(spark, d).select("transaction_id", ((F.col("fraud_probability") > 0.5) == (F.col("Class") == 1))
                                  .cast("int").alias("correct")),
        "correct", ["transaction_id"], name="cumulative_accuracy").select("transaction_id", "cumulative_accuracy"))

register("W7_cumulative_mean_amount", sql("tx", body="""SELECT transaction_id,
  CAST(sum(CAST("Amount" AS DECIMAL(38,2))) OVER (ORDER BY transaction_id ROWS UNBOUNDED PRECEDING) AS DOUBLE)
  / count("Amount") OVER (ORDER BY transaction_id ROWS UNBOUNDED PRECEDING) AS cumulative_mean FROM tx"""))(
    lambda spark, d: WN.cumulative_mean(V.tx(spark, d).select("transaction_id", "Amount"), "Amount",
                                        ["transaction_id"]).select("transaction_id", "cumulative_mean"))

register("W8_quartile_labels", sql("scored", """q AS (SELECT quantile_cont(fraud_probability, 0.25) AS q1,
  quantile_cont(fraud_probability, 0.5) AS q2, quantile_cont(fraud_probability, 0.75) AS q3 FROM scored)""",
                                   body="""SELECT CASE WHEN fraud_probability <= q1 THEN 'Low' WHEN fraud_probability <= q2 THEN 'Medium'
  WHEN fraud_probability <= q3 THEN 'High' ELSE 'Critical' END AS risk_quartile, count(*) AS n
FROM scored, q GROUP BY 1"""))(
    lambda spark, d: WN.quartile_labels(V.scored(spark, d)).groupBy("risk_quartile").agg(F.count(F.lit(1)).alias("n")))

# ---- drift -----------------------------------------------------------------

# the feature watched is the day of the week, whose mean drifts within a week; bounds of the
# histogram after e grains: level l holds the buckets from 2 * M(l + 1) to M(l), M(l) = floor((e + 4) / 2^l) - 4
_ADWIN_SQL = ["""rr AS (SELECT isodow(ts) - 1 AS v, "Time" AS t, row_number() OVER (ORDER BY "Time", transaction_id) AS r FROM tx)""",
              """gr AS (SELECT (r - 1) // 32 AS g, sum(v) AS ds, sum(v * v) AS dss, max(t) AS t FROM rr GROUP BY 1 HAVING count(*) = 32)""",
              """cu AS (SELECT g + 1 AS c, CAST(sum(ds) OVER o AS DOUBLE) AS s, CAST(sum(dss) OVER o AS DOUBLE) AS ss, t
  FROM gr WINDOW o AS (ORDER BY g ROWS UNBOUNDED PRECEDING))""",
              """le AS (SELECT c AS e, l, greatest(0, ((c + 4) >> l) - 4) AS m0, 2 * greatest(0, ((c + 4) >> (l + 1)) - 4) AS m1
  FROM cu, range(40) AS x(l))""",
              """bo AS (SELECT DISTINCT e, (j << l) AS c FROM (SELECT e, l, unnest(range(m1, m0 + 1)) AS j FROM le) AS y)""",
              """cc AS (SELECT e.c AS "end", c.c AS cut, c.t AS cut_time, e.t AS end_time, 32 * c.c AS n0, 32 * (e.c - c.c) AS n1,
  c.s / (32 * c.c) AS mu0, (e.s - c.s) / (32 * (e.c - c.c)) AS mu1,
  greatest(0.0, e.ss / (32 * e.c) - power(e.s / (32 * e.c), 2)) AS v,
  1.0::DOUBLE / (32 * c.c) + 1.0::DOUBLE / (32 * (e.c - c.c)) AS m, ln(2.0::DOUBLE * ln(CAST(32 * e.c AS DOUBLE)) / 0.002::DOUBLE) AS dd
  FROM bo JOIN cu e ON bo.e = e.c JOIN cu c ON bo.c = c.c WHERE bo.c < bo.e)""",
              """ce AS (SELECT *, sqrt(2.0::DOUBLE * m * v * dd) + (2.0::DOUBLE / 3.0::DOUBLE) * dd * m AS eps FROM cc)""",
              """cuts AS (SELECT *, abs(mu0 - mu1) > eps AS drift FROM ce)"""]


def _days(spark, d):
    return V.tx(spark, d).select("transaction_id", "Time", F.weekday("ts").alias("day"))


register("D1_adwin_cuts", sql("tx", *_ADWIN_SQL, body="""SELECT "end", count(*) AS cuts, count(*) FILTER (WHERE drift) AS drifting,
  min(cut) FILTER (WHERE drift) AS first_cut, round(sum(mu0 - mu1), 6) AS differences FROM cuts GROUP BY 1"""))(
    lambda spark, d: DR.adwin_cuts(_days(spark, d), "day").groupBy("end").agg(
        F.count(F.lit(1)).alias("cuts"), F.count_if("drift").alias("drifting"), F.min(F.when(F.col("drift"), F.col("cut"))).alias("first_cut"),
        F.round(F.sum(F.col("mu0") - F.col("mu1")), 6).alias("differences")))

_ADWIN_FIRST = """(SELECT * FROM cuts WHERE drift ORDER BY "end", round(abs(mu0 - mu1) - eps, 9) DESC, cut LIMIT 1)"""
register("D1_adwin_alert", sql("tx", *_ADWIN_SQL, body=f"""SELECT 'ADWIN' AS type, 'High' AS severity,
  'Significant drift detected in feature distribution' AS message, mu0 AS old_value, mu1 AS new_value,
  cut_time, end_time AS detected_time FROM {_ADWIN_FIRST}"""))(
    lambda spark, d: DR.adwin_alert(_days(spark, d), "day"))


def _ph_stats(spark, d):
    s = V.scored(spark, d).select("transaction_id", ((F.col("fraud_probability") > 0.5) == (F.col("Class") == 1))
                                  .cast("int").alias("correct"))
    acc = WN.cumulative_mean(s, "correct", ["transaction_id"], name="accuracy")
    return DR.page_hinkley(acc.select("transaction_id", "accuracy"), "accuracy", ["transaction_id"], threshold=0.5, alpha=1.0)


def _ph(spark, d):
    ph = _ph_stats(spark, d)
    return ph.select("transaction_id", "t", F.round("accuracy", 6).alias("accuracy"),
                     F.round("ph_up", 6).alias("ph_up"), F.round("ph_down", 6).alias("ph_down"), "drift")


register("D2_page_hinkley", sql("scored", """a AS (SELECT transaction_id,
  row_number() OVER (ORDER BY transaction_id) AS t,
  sum(CAST((fraud_probability > 0.5) = ("Class" = 1) AS INTEGER)) OVER (ORDER BY transaction_id ROWS UNBOUNDED PRECEDING)
    / row_number() OVER (ORDER BY transaction_id) AS x FROM scored)""",
                                """b AS (SELECT *, sum(x) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS sx FROM a)""",
                                """c AS (SELECT *, sum(sx / t) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS sxbar FROM b)""",
                                """m AS (SELECT *, sx - sxbar - 0.005::DOUBLE * t AS pm, sxbar - sx - 0.005::DOUBLE * t AS pu FROM c)""",
                                """mm AS (SELECT *, pm - min(pm) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS ph_up,
  pu - min(pu) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS ph_down FROM m)""",
                                body="""SELECT transaction_id, t, round(x, 6) AS accuracy, round(ph_up, 6) AS ph_up,
  round(ph_down, 6) AS ph_down, (t >= 30 AND (ph_up > 0.5 OR ph_down > 0.5)) AS drift FROM mm"""))(_ph)

register("D2_page_hinkley_alert", sql("scored", """a AS (SELECT transaction_id,
  row_number() OVER (ORDER BY transaction_id) AS t,
  sum(CAST((fraud_probability > 0.5) = ("Class" = 1) AS INTEGER)) OVER (ORDER BY transaction_id ROWS UNBOUNDED PRECEDING)
    / row_number() OVER (ORDER BY transaction_id) AS x FROM scored)""",
                                       """b AS (SELECT *, sum(x) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS sx FROM a)""",
                                       """c AS (SELECT *, sum(sx / t) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS sxbar FROM b)""",
                                       """m AS (SELECT *, sx - sxbar - 0.005::DOUBLE * t AS pm, sxbar - sx - 0.005::DOUBLE * t AS pu FROM c)""",
                                       """mm AS (SELECT *, pm - min(pm) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS ph_up,
  pu - min(pu) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS ph_down FROM m)""",
                                       body="""SELECT 'PageHinkley' AS type, 'Medium' AS severity, 'Model performance degradation detected' AS message,
  NULL::DOUBLE AS old_value, NULL::DOUBLE AS new_value, t FROM mm
WHERE t >= 30 AND (ph_up > 0.5 OR ph_down > 0.5) ORDER BY t LIMIT 1"""))(
    lambda spark, d: DR.page_hinkley_alert(_ph_stats(spark, d)))

def _ph_forgetting(spark, d):
    s = V.scored(spark, d).select("transaction_id", ((F.col("fraud_probability") > 0.5) == (F.col("Class") == 1))
                                  .cast("int").alias("correct"))
    acc = WN.cumulative_mean(s, "correct", ["transaction_id"], name="accuracy")
    ph = DR.page_hinkley(acc.select("transaction_id", "accuracy"), "accuracy", ["transaction_id"], threshold=0.5)
    return ph.select("transaction_id", "t", F.round("ph_up", 9).alias("ph_up"),
                     F.round("ph_down", 9).alias("ph_down"), "drift")


register("D2_page_hinkley_forgetting", sql("scored", """a AS (SELECT transaction_id,
  row_number() OVER (ORDER BY transaction_id) AS t,
  sum(CAST((fraud_probability > 0.5) = ("Class" = 1) AS INTEGER)) OVER (ORDER BY transaction_id ROWS UNBOUNDED PRECEDING)
    / row_number() OVER (ORDER BY transaction_id) AS x FROM scored)""",
                                           """b AS (SELECT *, sum(x) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) / t AS xbar FROM a)""",
                                           """m AS (SELECT *,
  pow(0.9999::DOUBLE, t) * sum(pow(0.9999::DOUBLE, -t) * (x - xbar - 0.005::DOUBLE)) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS pm,
  pow(0.9999::DOUBLE, t) * sum(pow(0.9999::DOUBLE, -t) * (xbar - x - 0.005::DOUBLE)) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS pu
  FROM b)""",
                                           """mm AS (SELECT *, pm - min(pm) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS ph_up,
  pu - min(pu) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS ph_down FROM m)""",
                                           body="""SELECT transaction_id, t, round(ph_up, 9) AS ph_up, round(ph_down, 9) AS ph_down,
  (t >= 30 AND (ph_up > 0.5 OR ph_down > 0.5)) AS drift FROM mm"""))(_ph_forgetting)

_DRIFT_BODY = """SELECT type, CASE WHEN chg > 0.2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  what || ' changed by ' || CAST(CAST(round(CAST(chg * 100.0 AS DECIMAL(38,10)), 2) AS DECIMAL(38,2)) AS VARCHAR) || '%' AS message, old_value, new_value FROM (
  SELECT 'Fraud Rate Drift' AS type, 'Fraud rate' AS what, abs(r1 - r0) AS chg, r0 AS old_value, r1 AS new_value FROM fl
  UNION ALL
  SELECT 'Probability Drift', 'Average probability', abs(p1 - p0), p0, p1 FROM fl) WHERE chg > 0.001"""
_FL = """fl AS (SELECT arg_min(fraud_rate, window_id) AS r0, arg_max(fraud_rate, window_id) AS r1,
  arg_min(avg_probability, window_id) AS p0, arg_max(avg_probability, window_id) AS p1 FROM ws HAVING count(*) >= 2)"""

register("D3_D4_window_drift", sql("scored", *_WIN_SQL, _FL, body=_DRIFT_BODY))(
    lambda spark, d: DR.window_drift(_wstats(spark, d), change=0.001))


def _alert_log(spark, d):
    return DR.alert_log(DR.adwin_alert(_days(spark, d), "day").drop("cut_time", "detected_time"), DR.window_drift(_wstats(spark, d), change=0.001))


register("D5_alert_log", sql("scored", *_ADWIN_SQL, *_WIN_SQL, _FL, """al AS (
  SELECT 'ADWIN' AS type, 'High' AS severity FROM """ + _ADWIN_FIRST + """
  UNION ALL SELECT type, severity FROM (""" + _DRIFT_BODY + "))", body="""SELECT type, severity, count(*) AS n FROM al GROUP BY 1, 2"""))(_alert_log)
