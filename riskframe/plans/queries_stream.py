"""Registered queries: Structured Streaming. Each stream runs until the
available files are consumed (``availableNow``) and its sink is returned as
a table, so a replay must equal the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import features as FE
from riskframe.operators import windows as WN
from riskframe.plans import views as V
from riskframe.plans.catalog import register
from riskframe.plans.oracle import sql
from riskframe.session import scratch_path
from riskframe.streaming import epochs as EP
from riskframe.streaming import profiles as PF
from riskframe.streaming import state as ST
from riskframe.streaming import stream as SS
from riskframe.streaming.velocity import STATE_CONF, trailing_count_stream

_XAVG = 'CAST(sum(CAST({x} AS DECIMAL(38,{s}))) AS DOUBLE) / count({x})'


def _scored_stream(spark, d, **kw):
    return SS.score_stream(SS.tx_stream(spark, d, **kw))


register("T2_stream_scoring", sql("banded", body="""SELECT transaction_id, fraud_probability, risk_level,
  CAST(fraud_probability >= 0.5 AS INTEGER) AS prediction FROM banded"""))(
    lambda spark, d: SS.run_to_table(_scored_stream(spark, d).select(
        "transaction_id", "fraud_probability", "risk_level", "prediction"), "scoring"))

register("T3_stream_alerts", sql("scored", body="""SELECT transaction_id, fraud_probability, 'HIGH' AS severity,
  'High-risk transaction detected: ' || CAST(CAST(round(CAST(fraud_probability AS DECIMAL(38,10)), 4) AS DECIMAL(38,4)) AS VARCHAR) AS message
FROM scored WHERE fraud_probability > 0.8"""))(
    lambda spark, d: SS.run_to_table(SS.alerts(_scored_stream(spark, d)), "alerts"))

_METRICS = f"""mt AS (SELECT count(*) AS total_processed,
  CAST(count(*) FILTER (WHERE fraud_probability >= 0.5) AS BIGINT) AS fraud_detected,
  count(*) FILTER (WHERE fraud_probability >= 0.5) / count(*) * 100.0 AS fraud_rate_pct,
  {_XAVG.format(x='"Amount"', s=2)} AS avg_amount FROM scored)"""

register("T4_stream_metrics", sql("scored", _METRICS, body="SELECT * FROM mt"))(
    lambda spark, d: SS.run_to_table(SS.running_metrics(_scored_stream(spark, d)), "metrics", mode="complete"))

register("T8_rate_alert", sql("scored", _METRICS, body="""SELECT 'high_fraud_rate' AS type, 'high' AS severity,
  'Fraud rate is ' || CAST(round(fraud_rate_pct, 3) AS VARCHAR) || '% - above threshold' AS message
FROM mt WHERE round(fraud_rate_pct, 3) > 1.0"""))(
    lambda spark, d: SS.rate_alerts(
        SS.run_to_table(SS.running_metrics(_scored_stream(spark, d)), "metrics8", mode="complete")))


def _enrich(spark, d):
    """T5: live rows enriched with profiles computed from the stored table
    (stream-static left joins)."""
    hist = V.tx(spark, d)
    cp = FE.customer_profile(hist).drop("tx_count")
    mp = FE.merchant_profile(hist)
    s = SS.tx_stream(spark, d)
    j = s.join(cp, "customer_id", "left").join(mp, "merchant_id", "left")
    return SS.run_to_table(j.select("transaction_id", "avg_amount_per_customer", "merchant_fraud_rate"), "enrich")


register("T5_stream_enrichment", sql("tx", body=f"""SELECT t.transaction_id, cp.a AS avg_amount_per_customer,
  mp.r AS merchant_fraud_rate FROM tx t
LEFT JOIN (SELECT customer_id, {_XAVG.format(x='"Amount"', s=2)} AS a FROM tx GROUP BY 1) cp ON t.customer_id = cp.customer_id
LEFT JOIN (SELECT merchant_id, avg(CAST("Class" AS DOUBLE)) AS r FROM tx GROUP BY 1) mp ON t.merchant_id = mp.merchant_id"""))(
    _enrich)


def _buffer(spark, d):
    s = _scored_stream(spark, d)
    t = SS.run_to_table(ST.last_n_buffer(s, "merchant_id", n=1000, n_windows=10), "buffer", mode="update",
                        keys=["merchant_id"])
    return t.select("merchant_id", "seen", "buffered", F.round("fraud_rate", 6).alias("fraud_rate"),
                    F.round("avg_probability", 6).alias("avg_probability"),
                    F.round("first_window_rate", 6).alias("first_window_rate"),
                    F.round("last_window_rate", 6).alias("last_window_rate"))


register("T6_last_n_buffer", sql("scored", """b AS (SELECT merchant_id, transaction_id, fraud_probability,
  CAST(fraud_probability >= 0.5 AS INTEGER) AS prediction,
  row_number() OVER (PARTITION BY merchant_id ORDER BY transaction_id DESC) AS rd,
  count(*) OVER (PARTITION BY merchant_id) AS seen FROM scored)""",
                                 """k AS (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY transaction_id) AS ra,
  count(*) OVER (PARTITION BY merchant_id) AS buffered FROM b WHERE rd <= 1000)""",
                                 body="""SELECT merchant_id, max(seen) AS seen, CAST(max(buffered) AS INTEGER) AS buffered,
  round(avg(CAST(prediction AS DOUBLE)), 6) AS fraud_rate, round(avg(fraud_probability), 6) AS avg_probability,
  round(avg(CAST(prediction AS DOUBLE)) FILTER (WHERE ra <= buffered // 10), 6) AS first_window_rate,
  round(avg(CAST(prediction AS DOUBLE)) FILTER (WHERE ra > 9 * (buffered // 10) AND ra <= 10 * (buffered // 10)), 6) AS last_window_rate
FROM k GROUP BY merchant_id"""))(_buffer)

register("T7_stream_windows", sql("scored", body=f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  count(*) AS n, avg(CAST(fraud_probability >= 0.5 AS DOUBLE)) AS fraud_rate,
  {_XAVG.format(x='fraud_probability', s=6)} AS avg_probability FROM scored GROUP BY 1"""))(
    lambda spark, d: SS.run_to_table(SS.windowed_rates(_scored_stream(spark, d)), "windows", mode="update",
                                     keys=["window_start"]))


#: spans that the feed of the queries over several micro-batches is cut into
PIECES = 4
#: a row's micro-batch, and the rows up to and with each
_PIECE = f"""p AS (SELECT *, CAST(floor(transaction_id * {PIECES} / ((SELECT max(transaction_id) FROM tx) + 1)) AS BIGINT) AS epoch FROM {{view}})"""


def _feed(spark, d):
    """The transactions as a stream of PIECES micro-batches in order of their ids."""
    path = scratch_path(spark, "feed")
    files = SS.feed(V.table(spark, d, "events"), "event_id", PIECES, path)
    return SS.tx_stream(spark, d, max_files_per_trigger=files, events_dir=path, events_glob="*.parquet")


def _run_scoring(spark, d, **kw):
    q, log = EP.start_scoring(SS.score_stream(_feed(spark, d)), **kw)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return log


def _updates(spark, d):
    """The messages' fields."""
    m = F.from_json("message", """type string, transaction struct<transaction_id long, Amount double, fraud_probability double,
  risk_level string>, statistics struct<total_transactions long, fraud_count long, fraud_rate double>""")
    t = _run_scoring(spark, d, buffer_key=None).read("updates").select(F.col("_epoch").cast("long").alias("epoch"), m.alias("m"))
    return t.select("epoch", "m.type", "m.transaction.*", "m.statistics.*")


register("T9_update_messages", sql("banded", _PIECE.format(view="banded"), """s AS (SELECT epoch, max(transaction_id) AS transaction_id,
  sum(count(*)) OVER (ORDER BY epoch) AS n, sum(count(*) FILTER (WHERE fraud_probability >= 0.5)) OVER (ORDER BY epoch) AS f
  FROM p GROUP BY epoch)""", body="""SELECT s.epoch, 'real_time_update' AS type, transaction_id, "Amount", fraud_probability, risk_level,
  CAST(n AS BIGINT) AS total_transactions, CAST(f AS BIGINT) AS fraud_count, round(f / n * 100.0, 3) AS fraud_rate
FROM s JOIN banded USING (transaction_id)"""))(_updates)


def _stream_drift(spark, d):
    """Drift between the first and last of ten windows over the last 200
    predictions, after every micro-batch."""
    t = _run_scoring(spark, d, buffer_key=None, last=200, change=0.01).read("drift")
    return t.select(F.col("_epoch").cast("long").alias("epoch"), "type", "severity", "old_value", "new_value")


register("T7_stream_drift", sql("scored", _PIECE.format(view="scored"), f"""l AS (SELECT e.epoch, fraud_probability,
  CAST(fraud_probability >= 0.5 AS INTEGER) AS prediction, row_number() OVER (PARTITION BY e.epoch ORDER BY transaction_id DESC) AS rd
  FROM p JOIN range({PIECES}) AS e(epoch) ON p.epoch <= e.epoch)""", """w AS (SELECT epoch, CAST((200 - rd) // 20 AS INTEGER) AS window_id,
  avg(CAST(prediction AS DOUBLE)) AS r, CAST(sum(CAST(fraud_probability AS DECIMAL(38,6))) AS DOUBLE) / count(*) AS m
  FROM l WHERE rd <= 200 GROUP BY 1, 2)""", """f AS (SELECT epoch, arg_min(r, window_id) AS r0, arg_max(r, window_id) AS r1,
  arg_min(m, window_id) AS p0, arg_max(m, window_id) AS p1 FROM w GROUP BY 1)""", body="""SELECT epoch, type,
  CASE WHEN abs(new_value - old_value) > 0.2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, old_value, new_value FROM (
  SELECT epoch, 'Fraud Rate Drift' AS type, r0 AS old_value, r1 AS new_value FROM f
  UNION ALL SELECT epoch, 'Probability Drift', p0, p1 FROM f) WHERE abs(new_value - old_value) > 0.01"""))(_stream_drift)


def _velocity(spark, d):
    """The trailing 24 h count of each row's customer, kept as state."""
    s = trailing_count_stream(_feed(spark, d).select("transaction_id", "customer_id", "ts"))
    return SS.run_to_table(s, "velocity", conf=STATE_CONF).select("transaction_id", "tx_freq_24h")


register("T5_stream_velocity", sql("tx", body="""SELECT transaction_id, count(*) OVER (PARTITION BY customer_id ORDER BY ts
  RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS tx_freq_24h FROM tx"""))(_velocity)


def _stored_profiles(spark, d):
    """Each row with its customer's profile over all earlier
    micro-batches, from the live profile table."""
    base = scratch_path(spark, "profiles")
    store = PF.ProfileStore(spark, f"{base}/store", buckets=8, merge_at=0.5)
    q, out = SS.start(_feed(spark, d), "profiles", path=f"{base}/rows", foreach_batch=PF.enrich_and_fold(store, f"{base}/rows", ["transaction_id"]))
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(out).drop("_epoch")


register("T5_stored_profiles", sql("tx", _PIECE.format(view="tx"), f"""c AS (SELECT customer_id, epoch, count(*) AS n, count("Amount") AS k,
  sum(CAST("Amount" AS DECIMAL(38,2))) AS s, count("Class") AS l, sum("Class") AS y FROM p GROUP BY 1, 2)""", body="""SELECT p.transaction_id,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS profile_tx_count, CAST(sum(s) AS DOUBLE) / sum(k) AS profile_avg_amount, sum(y) / sum(l) AS profile_rate
FROM p LEFT JOIN c ON p.customer_id = c.customer_id AND c.epoch < p.epoch GROUP BY p.transaction_id"""))(_stored_profiles)


def _batches(spark, d):
    """Every micro-batch of the stream with its number of rows (the
    trigger's file limit cuts them)."""
    s = _scored_stream(spark, d, max_files_per_trigger=1)
    out = scratch_path(spark, "sink-batches")

    def each(b, epoch, _):
        b.agg(F.count(F.lit(1)).alias("rows"), F.min("transaction_id").alias("first_id"),
              F.max("transaction_id").alias("last_id")).write.mode("overwrite").parquet(SS.epoch_dir(out, epoch, "batch"))

    q, _ = SS.start(s, "batches", foreach_batch=each)
    q.awaitTermination()
    t = spark.read.parquet(out)
    return t.agg(F.sum("rows").cast("long").alias("rows"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))


register("T1_micro_batches", sql("tx", body="""SELECT count(*) AS rows, min(transaction_id) AS first_id, max(transaction_id) AS last_id FROM tx"""))(_batches)


def _live(spark, d):
    """T5 kept current: each row carries its customer's count and mean amount
    over all strictly earlier transactions."""
    return SS.run_to_table(SS.live_profiles(SS.tx_stream(spark, d)), "live")


register("T5_live_profiles", sql("tx", body="""SELECT customer_id, transaction_id,
  count(*) OVER w AS profile_tx_count,
  CAST(sum(CAST(round("Amount" * 1000000) AS BIGINT)) OVER w AS DOUBLE) / 1000000.0::DOUBLE / count("Amount") OVER w AS avg_amount_per_customer
FROM tx WINDOW w AS (PARTITION BY customer_id ORDER BY transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))(_live)


#: a threshold that merchants' scores reach, and no forgetting, so that SQL can follow up to the first detection
_PH = {"threshold": 0.5, "min_instances": 5, "alpha": 1.0}


def _detector(spark, d):
    """Page-Hinkley over each merchant's scores; the first detection."""
    s = _scored_stream(spark, d)
    t = SS.run_to_table(ST.fold_detector(s, "merchant_id", "fraud_probability", factory=lambda: ST.PageHinkleyDetector(**_PH)),
                        "detector", mode="update", keys=["merchant_id"])
    return t.select("merchant_id", "n", (F.col("detections") > 0).alias("detected"), "first_at")


register("X2_stream_detector", sql("scored", """a AS (SELECT merchant_id, fraud_probability AS x,
  row_number() OVER (PARTITION BY merchant_id ORDER BY transaction_id) AS t,
  avg(fraud_probability) OVER (PARTITION BY merchant_id ORDER BY transaction_id ROWS UNBOUNDED PRECEDING) AS mean
  FROM scored)""", """b AS (SELECT *,
  sum(x - mean - 0.005::DOUBLE) OVER (PARTITION BY merchant_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS m,
  sum(mean - x - 0.005::DOUBLE) OVER (PARTITION BY merchant_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS u FROM a)""",
                                    """c AS (SELECT *, m - min(m) OVER (PARTITION BY merchant_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS up,
  u - min(u) OVER (PARTITION BY merchant_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS down FROM b)""",
                                    body="""SELECT merchant_id, count(*) AS n,
  count(*) FILTER (WHERE t >= 5 AND (up > 0.5 OR down > 0.5)) > 0 AS detected,
  min(t) FILTER (WHERE t >= 5 AND (up > 0.5 OR down > 0.5)) AS first_at FROM c GROUP BY merchant_id"""))(_detector)


def _stream_adwin(spark, d):
    """D1 on the stream: ADWIN over each event type's day of the month, which
    drifts by nature; events arrive in order of their id within a type."""
    s = SS.tx_stream(spark, d).withColumn("days", F.col("Time") / 86400.0)
    t = SS.run_to_table(ST.fold_detector(s, "transaction_type", "days", order="Time", factory=ST.AdwinDetector), "adwin",
                        mode="update", keys=["transaction_type"])
    return t.select("transaction_type", "n", (F.col("detections") > 0).alias("drifted"))


register("D1_stream_adwin", sql("tx", body="""SELECT transaction_type, count("Time") AS n, true AS drifted FROM tx GROUP BY 1"""))(
    _stream_adwin)


def _c6(spark, d):
    """Predictions with the counts of the other sinks beside them."""
    log = _run_scoring(spark, d)
    alerts = log.read("alerts").select("transaction_id", F.lit(True).alias("alerted"))
    return (log.read("predictions").drop("_epoch").join(alerts, "transaction_id", "left")
            .withColumns({"alerted": F.coalesce("alerted", F.lit(False)),
                          "total_processed": log.read_newest("metrics").select("total_processed").scalar(),
                          "buffered": EP.read_buffer(spark, log.base).agg(F.sum("buffered").cast("long")).scalar()}))


register("C6_start_scoring", sql("banded", """k AS (SELECT CAST(sum(least(n, 1000)) AS BIGINT) AS buffered
  FROM (SELECT merchant_id, count(*) AS n FROM banded GROUP BY 1))""", body="""SELECT transaction_id, fraud_probability, risk_level,
  CAST(fraud_probability >= 0.5 AS INTEGER) AS prediction, fraud_probability > 0.8 AS alerted,
  (SELECT count(*) FROM banded) AS total_processed, (SELECT buffered FROM k) AS buffered FROM banded"""))(_c6)

register("S8_read_predictions", sql("banded", body="""SELECT transaction_id, fraud_probability, risk_level,
  CAST(fraud_probability >= 0.5 AS INTEGER) AS prediction FROM banded ORDER BY transaction_id LIMIT 100"""))(
    lambda spark, d: SS.read_predictions(spark, _sink_predictions(spark, d), 100))


def _sink_predictions(spark, d):
    q, out = SS.start(_scored_stream(spark, d).select("transaction_id", "fraud_probability", "risk_level",
                                                      "prediction"), "s8")
    q.awaitTermination()
    return out


register("W3_last_alerts", sql("scored", body="""SELECT transaction_id, fraud_probability, 'HIGH' AS severity
FROM scored WHERE fraud_probability > 0.8 ORDER BY transaction_id DESC LIMIT 100"""))(
    lambda spark, d: WN.last_n(SS.alerts(SS.score_stream(V.scored(spark, d).drop("fraud_probability")))
                               .drop("message"), 100))
