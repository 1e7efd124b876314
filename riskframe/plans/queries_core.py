"""Registered queries: features, batch scoring summary (first slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import features as FE
from riskframe.operators import report as R
from riskframe.operators import windows as W
from riskframe.plans import views as V
from riskframe.plans.catalog import register
from riskframe.plans.oracle import sql


def score_history(spark, sf_dir, batch_size: int = 1000):
    """C5 core: positional batches of ``batch_size`` (W5), bands (F3),
    per-batch summary (A14)."""
    s = V.scored(spark, sf_dir).select("transaction_id", "fraud_probability")
    chunks = W.chunk_by_position(s, batch_size, order=("transaction_id",))
    return R.batch_summary(R.with_band(chunks), by="batch_id")


register("C5_score_history", sql(
    "banded",
    """b AS (SELECT *, (row_number() OVER (ORDER BY transaction_id) - 1) // 1000 AS batch_id FROM banded)""",
    body="""SELECT batch_id,
       count(*) AS total_transactions,
       count(*) FILTER (WHERE risk_level = 'High') AS high_risk_count,
       count(*) FILTER (WHERE risk_level = 'Medium') AS medium_risk_count,
       count(*) FILTER (WHERE risk_level = 'Low') AS low_risk_count,
       count(*) FILTER (WHERE risk_level = 'High') / count(*) AS fraud_rate
FROM b GROUP BY batch_id"""))(score_history)


def _features(spark, sf_dir, unit, freq):
    df = V.tx(spark, sf_dir).drop("ts")
    out = FE.engineer_features(df, unit=unit, freq=freq)
    return out.select("transaction_id", "hour_of_day", "day_of_week",
                      "avg_amount_per_customer",
                      "tx_freq_24h",
                      "merchant_fraud_rate")


_FEAT_SQL = """f AS (
  SELECT t.transaction_id,
         {hour} AS hour_of_day,
         {dow} AS day_of_week,
         cp.avg_amount_per_customer,
         {freq} AS tx_freq_24h,
         mp.merchant_fraud_rate
  FROM tx t
  LEFT JOIN (SELECT customer_id, CAST(sum(CAST("Amount" AS DECIMAL(38,2))) AS DOUBLE) / count("Amount") AS avg_amount_per_customer, count(*) AS n
             FROM tx GROUP BY customer_id) cp ON t.customer_id = cp.customer_id
  LEFT JOIN (SELECT merchant_id, avg(CAST("Class" AS DOUBLE)) AS merchant_fraud_rate
             FROM tx GROUP BY merchant_id) mp ON t.merchant_id = mp.merchant_id)"""
_FEAT_BODY = """SELECT transaction_id, hour_of_day, day_of_week,
       coalesce(avg_amount_per_customer, (SELECT CAST(sum(CAST("Amount" AS DECIMAL(38,2))) AS DOUBLE) / count("Amount") FROM tx)) AS avg_amount_per_customer,
       coalesce(tx_freq_24h, 1) AS tx_freq_24h,
       coalesce(merchant_fraud_rate, 0.0) AS merchant_fraud_rate
FROM f"""
_TRAIL = """(SELECT count(*) FROM tx u WHERE u.customer_id = t.customer_id
            AND u."Time" BETWEEN t."Time" - 86400.0 AND t."Time")"""
_TRAIL_W = """count(*) OVER (PARTITION BY t.customer_id ORDER BY t."Time"
                    RANGE BETWEEN 86400.0 PRECEDING AND CURRENT ROW)"""

register("C3_features_seconds", sql(
    "tx", _FEAT_SQL.format(hour='CAST(floor("Time" / 3600.0) % 24 AS INTEGER)',
                           dow='CAST(floor("Time" / 86400.0) % 7 AS INTEGER)', freq=_TRAIL_W),
    body=_FEAT_BODY))(lambda spark, d: _features(spark, d, "seconds", "trailing"))

register("C3_features_reference", sql(
    "tx", _FEAT_SQL.format(hour='CAST(floor("Time") % 24 AS INTEGER)',
                           dow='CAST(floor("Time" / 24.0) % 7 AS INTEGER)', freq="cp.n"),
    body=_FEAT_BODY))(lambda spark, d: _features(spark, d, "reference", "reference"))


def merchant_profiles_big(spark, sf_dir):
    """A3 + A4 at scale on ``tx_big`` (lineitem + orders): per merchant
    (supplier) rows, mean amount and label rate, and per customer rows and
    mean amount, as one long table."""
    t = V.tx_big(spark, sf_dir)
    m = t.groupBy(F.col("merchant_id").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("Amount"), 6).alias("avg_amount"),
        F.avg(F.col("Class").cast("double")).alias("label_rate")).withColumn("kind", F.lit("merchant"))
    c = t.groupBy(F.col("customer_id").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("Amount"), 6).alias("avg_amount"),
        F.avg(F.col("Class").cast("double")).alias("label_rate")).withColumn("kind", F.lit("customer"))
    return m.unionByName(c)


register("A3_A4_profiles_tx_big", sql("tx_big", body="""SELECT merchant_id AS key, count(*) AS n, round(avg("Amount"), 6) AS avg_amount,
  avg(CAST("Class" AS DOUBLE)) AS label_rate, 'merchant' AS kind FROM tx_big GROUP BY 1
UNION ALL SELECT customer_id, count(*), round(avg("Amount"), 6), avg(CAST("Class" AS DOUBLE)), 'customer' FROM tx_big GROUP BY 1"""))(
    merchant_profiles_big)


register("W2_trailing_24h_count", sql("tx", body="""SELECT transaction_id,
  count(*) OVER (PARTITION BY customer_id ORDER BY "Time" RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS tx_freq_24h
FROM tx"""))(lambda spark, d: FE.trailing_count(V.tx(spark, d).select("transaction_id", "customer_id", "Time"))
             .select("transaction_id", "tx_freq_24h"))


def _profiles_join(spark, d):
    t = V.tx(spark, d).select("transaction_id", "customer_id", "merchant_id", "Amount", "Class")
    j = FE.attach(FE.attach(t, FE.customer_profile(t), "customer_id"), FE.merchant_profile(t), "merchant_id")
    return j.select("transaction_id", "avg_amount_per_customer", "tx_count", "merchant_fraud_rate")


register("J1_J2_profile_joins", sql("tx", body="""SELECT t.transaction_id, cp.a AS avg_amount_per_customer, cp.n AS tx_count,
  mp.r AS merchant_fraud_rate FROM tx t
LEFT JOIN (SELECT customer_id, CAST(sum(CAST("Amount" AS DECIMAL(38,2))) AS DOUBLE) / count("Amount") AS a, count(*) AS n
           FROM tx GROUP BY 1) cp ON t.customer_id = cp.customer_id
LEFT JOIN (SELECT merchant_id, avg(CAST("Class" AS DOUBLE)) AS r FROM tx GROUP BY 1) mp ON t.merchant_id = mp.merchant_id"""))(
    _profiles_join)

register("Q3_point_in_time_rate", sql("tx", """m AS (SELECT merchant_id, "Time", count("Class") AS n, sum("Class") AS y FROM tx GROUP BY 1, 2)""",
                                      """b AS (SELECT merchant_id, "Time", sum(y) OVER w / sum(n) OVER w AS r FROM m
  WINDOW w AS (PARTITION BY merchant_id ORDER BY "Time" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW))""",
                                      body="""SELECT transaction_id, r AS merchant_fraud_rate
FROM tx LEFT JOIN b ON tx.merchant_id IS NOT DISTINCT FROM b.merchant_id AND tx."Time" = b."Time" """))(
    lambda spark, d: FE.earlier_rate(V.tx(spark, d).select("transaction_id", "merchant_id", "Time", "Class"))
    .select("transaction_id", "merchant_fraud_rate"))


# kept under its old name: the ranked plan is the only one now
register("W2_trailing_24h_count_ranked", sql("tx", body="""SELECT transaction_id,
  count(*) OVER (PARTITION BY customer_id ORDER BY "Time" RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS tx_freq_24h
FROM tx"""))(lambda spark, d: FE.trailing_count(V.tx(spark, d).select("transaction_id", "customer_id", "Time"))
             .select("transaction_id", "tx_freq_24h"))
