"""Registered queries: profiling, validation, sources, projections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions import scalars as X
from riskframe.operators import features as FE
from riskframe.operators import profile as PR
from riskframe.operators import sketches as SK
from riskframe.operators import validate as VA
from riskframe.operators import windows as WN
from riskframe.plans import views as V
from riskframe.plans.catalog import register
from riskframe.plans.oracle import ML_COLUMNS, sql
from riskframe.session import scratch_path
from riskframe.sources import records as RC
from riskframe.sources import tables as TB

TX_COLS = ["transaction_id", "Time", "Amount", "customer_id", "merchant_id", "transaction_type",
           "card_type", "region", "channel", "Class"]
_DOUBLES = {"Time", "Amount"}


def _q(c):
    return f'"{c}"'


def _null_sql():
    parts = []
    for c in TX_COLS:
        cond = f"{_q(c)} IS NULL" + (f" OR isnan({_q(c)})" if c in _DOUBLES else "")
        parts.append(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {cond}) AS null_count FROM tx")
    return sql("tx", body="\nUNION ALL ".join(parts))


register("P2_null_profile", _null_sql())(
    lambda spark, d: PR.null_profile(V.tx(spark, d).select(*TX_COLS), only_positive=False))

register("A1_dataset_summary", sql("tx", body="""SELECT count(*) AS rows,
  count(*) FILTER (WHERE "Class" = 0) AS normal_count,
  count(*) FILTER (WHERE "Class" = 1) AS fraud_count,
  round(sum("Class") / count(*) * 100.0, 6) AS fraud_rate_pct,
  CAST(sum(CAST("Amount" AS DECIMAL(38,2))) AS DOUBLE) / count("Amount") AS amount_mean,
  round(stddev_samp("Amount"), 6) AS amount_std,
  min("Amount") AS amount_min, max("Amount") AS amount_max,
  10 AS columns, round(quantile_cont("Amount", 0.5), 6) AS amount_median
FROM tx"""))(lambda spark, d: PR.dataset_summary(V.tx(spark, d).select(*TX_COLS)))

register("A2_value_counts", sql("tx", body="""SELECT transaction_type AS value, count(*) AS n
FROM tx GROUP BY transaction_type ORDER BY n DESC, value"""))(
    lambda spark, d: PR.value_counts(V.tx(spark, d), "transaction_type"))

register("A5_distinct_counts", sql("tx", body="""SELECT count(DISTINCT customer_id) AS distinct_customer_id,
  count(DISTINCT merchant_id) AS distinct_merchant_id FROM tx"""))(
    lambda spark, d: PR.distinct_counts(V.tx(spark, d)))


def _describe_sql(inner: str) -> str:
    return f"""SELECT grouping, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  round(CAST(min(v) AS DOUBLE), 6) AS min, round(quantile_cont(v, 0.25), 6) AS p25,
  round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75,
  round(CAST(max(v) AS DOUBLE), 6) AS max
FROM ({inner}) s GROUP BY grouping"""


register("A6_group_size_describe", sql("tx", body=_describe_sql("""
  SELECT 'customer_id' AS grouping, CAST(count(*) AS DOUBLE) AS v FROM tx GROUP BY customer_id
  UNION ALL SELECT 'merchant_id', CAST(count(*) AS DOUBLE) FROM tx GROUP BY merchant_id
  UNION ALL SELECT 'hour_of_day', CAST(count(*) AS DOUBLE) FROM tx GROUP BY CAST(floor("Time" / 3600.0) % 24 AS INTEGER)""")))(
    lambda spark, d: PR.group_size_describe(FE.time_features(V.tx(spark, d))))

register("A7_group_rate_describe", sql("tx", body=_describe_sql("""
  SELECT 'merchant_id' AS grouping, avg(CAST("Class" AS DOUBLE)) AS v FROM tx GROUP BY merchant_id
  UNION ALL SELECT 'customer_id', avg(CAST("Class" AS DOUBLE)) FROM tx GROUP BY customer_id""")))(
    lambda spark, d: PR.group_rate_describe(V.tx(spark, d)))

register("A8_time_span_days", sql("tx", body="""SELECT round((max("Time") - min("Time")) / 86400.0, 6) AS time_span_days FROM tx"""))(
    lambda spark, d: PR.time_span_days(V.tx(spark, d)))


def _hist_sql(col: str, bins: int) -> str:
    return sql("tx", f"""mm AS (SELECT min({_q(col)}) AS lo, max({_q(col)}) AS hi FROM tx)""",
               f"""h AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor(({_q(col)} - lo) * ({bins}.0 / (hi - lo))), {bins - 1}) END AS INTEGER) AS bin, lo, hi
        FROM tx, mm WHERE {_q(col)} IS NOT NULL)""",
               body=f"""SELECT bin, round(lo + bin * ((hi - lo) / {bins}.0), 6) AS lower,
  round(lo + (bin + 1) * ((hi - lo) / {bins}.0), 6) AS upper, count(*) AS n
FROM h GROUP BY bin, lo, hi""")


register("A11_histogram_amount", _hist_sql("Amount", 50))(
    lambda spark, d: PR.histogram(V.tx(spark, d), "Amount", 50))
register("A11_histogram_time", _hist_sql("Time", 50))(
    lambda spark, d: PR.histogram(V.tx(spark, d), "Time", 50))

register("A12_box_amount_by_class", sql(
    "tx", """q AS (SELECT "Class", quantile_cont("Amount", 0.25) AS q1, quantile_cont("Amount", 0.5) AS med,
                   quantile_cont("Amount", 0.75) AS q3 FROM tx GROUP BY "Class")""",
    body="""SELECT t."Class", round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(q3 - q1, 6) AS iqr,
  round(min("Amount") FILTER (WHERE "Amount" >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max("Amount") FILTER (WHERE "Amount" <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (WHERE "Amount" < q1 - 1.5 * (q3 - q1) OR "Amount" > q3 + 1.5 * (q3 - q1)) AS outliers
FROM tx t JOIN q ON t."Class" = q."Class" GROUP BY t."Class", q1, med, q3"""))(
    lambda spark, d: PR.box_stats(V.tx(spark, d), "Amount", "Class"))

CORR_COLS = [*ML_COLUMNS, "Class"]


def _corr_sql():
    """One row per pair from one aggregate over the unpivoted columns' products."""
    pairs = [(a, b) for k, a in enumerate(CORR_COLS) for b in CORR_COLS[k:]]
    cols = ", ".join(f'round(corr(CAST({_q(a)} AS DOUBLE), CAST({_q(b)} AS DOUBLE)), 6) AS "{a}|{b}"' for a, b in pairs if a != b)
    return sql("ml", f"w AS (SELECT {cols} FROM ml)", """u AS (UNPIVOT w ON COLUMNS(*) INTO NAME pair VALUE corr)""",
               """k AS (SELECT string_split(pair, '|')[1] AS col_a, string_split(pair, '|')[2] AS col_b, corr FROM u)""",
               "d AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in CORR_COLS) + "]) AS c)",
               body="""SELECT col_a, col_b, corr FROM k UNION ALL SELECT col_b, col_a, corr FROM k
UNION ALL SELECT c, c, 1.0::DOUBLE FROM d""")


register("A13_corr_matrix", _corr_sql())(lambda spark, d: PR.corr_matrix(V.ml(spark, d), [*V.ml_columns(spark, d), "Class"]))

register("A22_class_balance", sql("tx", body="""SELECT CASE WHEN "Class" = 1 THEN 'fraud' ELSE 'normal' END AS class_name,
  count(*) AS n FROM tx GROUP BY 1"""))(lambda spark, d: PR.class_balance(V.tx(spark, d)))

#: rows made bad by their id: negative, missing or not a number
_BAD_AMOUNT = """CASE WHEN transaction_id % 97 = 5 THEN '-1' WHEN transaction_id % 101 = 7 THEN NULL
  WHEN transaction_id % 89 = 3 THEN 'n/a' ELSE CAST("Amount" AS VARCHAR) END"""


def _bad_amounts(spark, d):
    i = F.col("transaction_id")
    return V.tx(spark, d).withColumn("Amount", F.when(i % 97 == 5, F.lit("-1")).when(i % 101 == 7, F.lit(None)).when(
        i % 89 == 3, F.lit("n/a")).otherwise(F.col("Amount").cast("string")))


register("P3_violation_summary", sql("tx", f"""b AS (SELECT *, {_BAD_AMOUNT} AS a FROM tx)""",
                                     """v AS (SELECT 'missing:Amount' AS violation FROM b WHERE a IS NULL
  UNION ALL SELECT 'non_numeric:Amount' FROM b WHERE a IS NOT NULL AND TRY_CAST(a AS DOUBLE) IS NULL
  UNION ALL SELECT 'negative:Amount' FROM b WHERE TRY_CAST(a AS DOUBLE) < 0
  UNION ALL SELECT 'missing:customer_id' FROM b WHERE customer_id IS NULL
  UNION ALL SELECT 'missing:merchant_id' FROM b WHERE merchant_id IS NULL
  UNION ALL SELECT 'valid' FROM b WHERE TRY_CAST(a AS DOUBLE) >= 0 AND customer_id IS NOT NULL AND merchant_id IS NOT NULL)""",
                                     body="SELECT violation, count(*) AS n FROM v GROUP BY 1"))(
    lambda spark, d: VA.violation_summary(_bad_amounts(spark, d), required=("Time", "Amount", "customer_id", "merchant_id")))

register("P1_required_columns", sql("tx", body="""SELECT transaction_id, "Time", "Amount" FROM tx"""))(
    lambda spark, d: VA.require_columns(V.tx(spark, d), ["Time", "Amount"]).select("transaction_id", "Time", "Amount"))

register("P4_fill_defaults", sql("tx", body="""SELECT transaction_id,
  CASE WHEN channel = 'atm' THEN 'web' ELSE channel END AS channel, coalesce(region, 'US') AS region FROM tx"""))(
    lambda spark, d: VA.fill_defaults(V.tx(spark, d).withColumn("channel", F.when(F.col("channel") != "atm", F.col("channel"))))
    .select("transaction_id", "channel", "region"))

_NUMERIC = ["transaction_id", "Time", "Amount", "customer_id", "merchant_id"]
register("P8_P9_numeric_features", sql("tx", body="SELECT " + ", ".join(f'"{c}"' for c in _NUMERIC) + " FROM tx"))(
    lambda spark, d: (lambda t: VA.select_features(t, VA.numeric_columns(t)))(V.tx(spark, d)))

register("P13_derive_if_absent", sql("tx", body="""SELECT transaction_id, channel,
  CAST(floor("Time" / 3600.0) % 24 AS INTEGER) AS hour_of_day FROM tx"""))(
    lambda spark, d: VA.derive_if_absent(V.tx(spark, d), {"hour_of_day": X.hour_of_day("Time"), "channel": F.lit("none")})
    .select("transaction_id", "channel", "hour_of_day"))


def _stored(spark, d):
    """Scored rows, stored and read back."""
    path = scratch_path(spark, "scored")
    V.scored(spark, d).select("transaction_id", "fraud_probability").write.parquet(path)
    return TB.read_scored(spark, path)


register("S2_stored_scores", sql("scored", body="SELECT transaction_id, fraud_probability FROM scored"))(_stored)


def _records(spark, d):
    """S3: the last request's hundred records, as a table."""
    rows = WN.last_n(V.tx(spark, d).select("transaction_id", "Time", "Amount", "region"), 100)
    records = [{**r.asDict(), "transaction_id": str(r["transaction_id"])} for r in rows.collect()]
    return TB.from_records(spark, records).select("transaction_id", "Time", "Amount", "region")


register("S3_from_records", sql("tx", body="""SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, "Time", "Amount", region
FROM tx ORDER BY tx.transaction_id DESC LIMIT 100"""))(_records)

_DISPLAY = {"transaction_id": "transaction_id", "Amount": "amount", "fraud_probability": "risk_score",
            "transaction_type": "type", "region": "region", "missing_col": "never"}
register("P11_display_high_risk", sql("scored", body="""SELECT transaction_id, round("Amount", 4) AS amount,
  round(fraud_probability, 4) AS risk_score, transaction_type AS type, region
FROM scored WHERE fraud_probability > 0.7"""))(
    lambda spark, d: VA.display_columns(V.scored(spark, d).filter(F.col("fraud_probability") > 0.7), _DISPLAY))

register("P12_sample_rows", sql("tx", body="""SELECT transaction_id, "Amount" FROM tx
ORDER BY md5(CAST(transaction_id AS VARCHAR) || ':42'), transaction_id LIMIT 500"""))(
    lambda spark, d: VA.sample_rows(V.tx(spark, d), 500, seed=42).select("transaction_id", "Amount"))

register("S1_scan_events", """SELECT event_id, user_id, event_type, value FROM events""")(
    lambda spark, d: TB.read_transactions(spark, f"{d}/events.parquet", fmt="parquet").select(
        "event_id", "user_id", "event_type", "value"))

_PROPS = T.StructType([T.StructField("k", T.LongType(), True)])
register("S4_parse_props", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  coalesce(NOT json_valid(props), false) AS _corrupt FROM events""")(
    lambda spark, d: RC.parse_json(V.table(spark, d, "events", "event_id", "props"), "props", _PROPS,
                                   keep=["event_id"]))

register("P7_features_target", sql("ml", body="""SELECT * EXCLUDE ("Class") FROM ml"""))(
    lambda spark, d: VA.split_target(V.ml(spark, d))[0])
register("P7_target", sql("ml", body="""SELECT "Class" FROM ml"""))(lambda spark, d: VA.split_target(V.ml(spark, d))[1])

register("W1_group_stats_to_rows", sql("tx", body="""SELECT transaction_id,
  CAST(sum(CAST("Amount" AS DECIMAL(38,2))) OVER (PARTITION BY merchant_id) AS DOUBLE)
    / count("Amount") OVER (PARTITION BY merchant_id) AS merchant_avg_amount,
  count(*) OVER (PARTITION BY merchant_id) AS merchant_tx FROM tx"""))(
    lambda spark, d: FE.group_stats_to_rows(V.tx(spark, d), "merchant_id", {
        "merchant_avg_amount": X.exact_avg("Amount"), "merchant_tx": F.count(F.lit(1))}).select(
        "transaction_id", "merchant_avg_amount", "merchant_tx"))


def _fallback(spark, d):
    df = V.tx(spark, d).drop("customer_id", "merchant_id", "ts")
    out = FE.engineer_features(df)
    return out.select("transaction_id", "avg_amount_per_customer", "tx_freq_24h", "merchant_fraud_rate")


register("P6_global_fallback", sql("tx", body="""SELECT transaction_id,
  (SELECT CAST(sum(CAST("Amount" AS DECIMAL(38,2))) AS DOUBLE) / count("Amount") FROM tx) AS avg_amount_per_customer,
  CAST(1 AS BIGINT) AS tx_freq_24h,
  (SELECT avg(CAST("Class" AS DOUBLE)) FROM tx) AS merchant_fraud_rate FROM tx"""))(_fallback)


def _enrich(spark, d):
    """Profiles fitted on the first 80 % of the time span, attached to
    the later rows (new traffic), nulls filled from the fitted rows."""
    t = V.tx(spark, d).drop("ts")
    cut = t.agg(F.max("Time") * 0.8).scalar()
    train, new = t.filter(F.col("Time") < cut), t.filter(F.col("Time") >= cut)
    out = FE.engineer_features(new, fit_df=train, freq="reference")
    return out.select("transaction_id", "avg_amount_per_customer", "tx_freq_24h", "merchant_fraud_rate")


register("J3_profile_enrichment", sql(
    "tx", """c AS (SELECT max("Time") * 0.8 AS cut FROM tx)""",
    """tr AS (SELECT tx.* FROM tx, c WHERE "Time" < cut)""",
    """nw AS (SELECT tx.* FROM tx, c WHERE "Time" >= cut)""",
    body="""SELECT nw.transaction_id,
  coalesce(cp.a, (SELECT CAST(sum(CAST("Amount" AS DECIMAL(38,2))) AS DOUBLE) / count("Amount") FROM tr)) AS avg_amount_per_customer,
  coalesce(cp.n, 1) AS tx_freq_24h,
  coalesce(mp.r, 0.0) AS merchant_fraud_rate
FROM nw
LEFT JOIN (SELECT customer_id, CAST(sum(CAST("Amount" AS DECIMAL(38,2))) AS DOUBLE) / count("Amount") AS a,
                  count(*) AS n FROM tr GROUP BY customer_id) cp
  ON nw.customer_id = cp.customer_id
LEFT JOIN (SELECT merchant_id, avg(CAST("Class" AS DOUBLE)) AS r FROM tr GROUP BY merchant_id) mp
  ON nw.merchant_id = mp.merchant_id"""))(_enrich)


def _hist_sql_over(view: str, src: str, col: str, bins: int, extra=()) -> str:
    return sql(view, *extra, f"""hv AS (SELECT {col} AS v FROM {src})""",
               """mm AS (SELECT min(v) AS lo, max(v) AS hi FROM hv)""",
               f"""h AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) * ({bins}.0 / (hi - lo))), {bins - 1}) END AS INTEGER) AS bin, lo, hi
        FROM hv, mm WHERE v IS NOT NULL)""",
               body=f"""SELECT bin, round(lo + bin * ((hi - lo) / {bins}.0), 6) AS lower,
  round(lo + (bin + 1) * ((hi - lo) / {bins}.0), 6) AS upper, count(*) AS n
FROM h GROUP BY bin, lo, hi""")


register("A11_histogram_v1", _hist_sql_over("ml", "ml", '"V1"', 50))(
    lambda spark, d: PR.histogram(V.ml(spark, d), "V1", 50))
register("A11_histogram_score", _hist_sql_over("scored", "scored", "fraud_probability", 30))(
    lambda spark, d: PR.histogram(V.scored(spark, d), "fraud_probability", 30))
register("A11_histogram_activity", _hist_sql_over(
    "tx", "act", "CAST(n AS DOUBLE)", 50, extra=("""act AS (SELECT customer_id, count(*) AS n FROM tx GROUP BY 1)""",)))(
    lambda spark, d: PR.histogram(V.tx(spark, d).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")), "n", 50))


def _box_rate(spark, d):
    t = V.tx(spark, d).select("transaction_id", "merchant_id", "Class")
    f = FE.attach(t, FE.merchant_profile(t), "merchant_id")
    return PR.box_stats(f, "merchant_fraud_rate", "Class")


register("A12_box_merchant_rate_by_class", sql(
    "tx", """f AS (SELECT t.transaction_id, t."Class", mp.r AS v FROM tx t
  LEFT JOIN (SELECT merchant_id, avg(CAST("Class" AS DOUBLE)) AS r FROM tx GROUP BY 1) mp ON t.merchant_id = mp.merchant_id)""",
    """q AS (SELECT "Class", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3
  FROM f GROUP BY "Class")""",
    body="""SELECT f."Class", round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
  round(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
FROM f JOIN q ON f."Class" = q."Class" GROUP BY f."Class", q1, med, q3"""))(_box_rate)


def _sketch_rollup(spark, d):
    """A month's figures from stored daily sketches, each held
    against the exact ones: within 5 % (distinct) and 2 % of the ranks (quartiles)."""
    tx = V.tx(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "customer_id", "merchant_id", "Amount")
    path = scratch_path(spark, "sketches")
    SK.store(SK.summarise(tx, ["day"], ["customer_id", "merchant_id"], ["Amount"]), path, "1")
    month = F.substring("day", 1, 7).alias("month")
    est = SK.rollup(SK.stored(spark, path), [month])
    rows = tx.withColumn("month", month).join(est.withColumnRenamed("rows", "stored_rows"), "month")
    near = [F.abs(F.count_distinct(c) - F.first(f"distinct_{c}")) <= 0.05 * F.count_distinct(c) for c in ("customer_id", "merchant_id")]
    ranks = [F.abs(F.count_if(F.col("Amount") <= F.col(f"q_{q}_Amount")) / F.count("Amount") - q / 100.0) <= 0.02 for q in (25, 50, 75)]
    return rows.groupBy("month").agg(F.first("stored_rows").alias("rows"), near[0].alias("customers_near"), near[1].alias("merchants_near"),
                                     (ranks[0] & ranks[1] & ranks[2]).alias("quartiles_near"))


register("A5_A11_sketch_rollup", sql("tx", body="""SELECT strftime(ts, '%Y-%m') AS month, count(*) AS rows, true AS customers_near,
  true AS merchants_near, true AS quartiles_near FROM tx GROUP BY 1"""))(_sketch_rollup)
