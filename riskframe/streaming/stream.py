"""Structured Streaming: sources, scoring, alerts, running metrics,
enrichment, event-time windows, periodic updates (S7-S8, T1-T5, T7-T9, C6).

The reference's thread-and-queue loop becomes a streaming query: the
trigger interval replaces the 0.1 s poll, ``maxFilesPerTrigger`` replaces the
100-row batch cap, and the checkpoint location that the caller gives replaces
in-memory state that was lost on exit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskframe import schema as S
from riskframe.functions import scalars as X
from riskframe.plans import views as V
from riskframe.session import drop_path, materialize, scratch_path


# ---- sources (S7) ---------------------------------------------------------

def file_stream(spark: SparkSession, directory: str, schema, fmt: str = "parquet", name_glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """New files in ``directory`` become micro-batches (FIFO by file
    time). ``max_files_per_trigger`` bounds a micro-batch (T1)."""
    r = spark.readStream.schema(schema).format(fmt)
    if name_glob:
        r = r.option("pathGlobFilter", name_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(directory)


def tx_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None,
              events_dir: str | None = None, events_glob: str | None = "events.parquet") -> DataFrame:
    """The ``tx`` view over a stream of event files, enriched by
    stream-static joins with the customer and geography tables (T5)."""
    static_ev = V.table(spark, sf_dir, "events")
    ev = file_stream(spark, events_dir or sf_dir, static_ev.schema, name_glob=events_glob,
                     max_files_per_trigger=max_files_per_trigger)
    t0 = static_ev.agg(F.min("ts")).first()[0]   # one value: the stream's time origin
    cust = V.table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    geo = V.geography(spark, sf_dir)
    cust_geo = (cust.join(F.broadcast(geo), cust.c_nationkey == geo.n_nationkey, "left")
                .select("c_custkey", "c_mktsegment", "r_name"))
    merchant = F.get_json_object(F.col("props"), "$.k").cast("long")
    channel = F.element_at(F.array(*[F.lit(c) for c in S.CHANNELS]), (F.pmod(merchant, F.lit(4)) + 1).cast("int"))
    # no hint: Spark broadcasts by the byte size it knows, and shuffles beyond its threshold
    j = ev.join(cust_geo, ev.user_id == cust_geo.c_custkey, "left")
    return j.select(
        F.col("event_id").alias("transaction_id"), F.col("ts").cast("timestamp").alias("ts"),
        (F.timestamp_diff("MICROSECOND", F.lit(t0), F.col("ts")) / 1e6).alias("Time"),
        F.col("value").alias("Amount"), F.col("user_id").alias("customer_id"), merchant.alias("merchant_id"),
        F.col("event_type").alias("transaction_type"), F.col("c_mktsegment").alias("card_type"),
        F.col("r_name").alias("region"), channel.alias("channel"),
        ((F.col("event_type") == "error") & (F.col("value") >= 75)).cast("int").alias("Class"))


def feed(df: DataFrame, order: str, pieces: int, path: str) -> int:
    """Write ``df`` as a feed for :func:`file_stream`: ``pieces`` equal spans of
    the whole number ``order``, one after the other, so that a stream takes them in
    this order. Returns the files of a span: the ``max_files_per_trigger`` for which
    each is a micro-batch."""
    from riskframe.operators.prefix import auto_partitions

    top = df.agg(F.max(order)).first()[0] or 0
    files = auto_partitions(df)
    for k in range(pieces):
        span = df.where(F.floor(F.col(order) * pieces / (top + 1)) == k)
        span = span.coalesce(1) if files == 1 else span.repartition(files)
        span.write.mode("append").parquet(path)
    return files


# ---- operators --------------------------------------------------------------

def score_stream(stream: DataFrame, scorer=None, name: str = "model", threshold: float = 0.5) -> DataFrame:
    """Stateless scoring with the same scorer as batch (an ML model's
    ``transform`` works on streaming frames). Default scorer: the
    deterministic stand-in. A row without a score is banded ``Error`` and
    predicted 0."""
    if scorer is None:
        out = stream.withColumn("fraud_probability", V.stand_in_probability())
    else:
        out = scorer(stream).withColumnRenamed(f"p_{name}", "fraud_probability")
    hit = F.coalesce(X.threshold_classify("fraud_probability", threshold), F.lit(0))
    return out.withColumns({"risk_level": X.risk_band("fraud_probability"), "prediction": hit})


def score_stream_models(stream: DataFrame, scorers: dict, thresholds: dict[str, float] | None = None,
                        preference=("ensemble", "gbt")) -> DataFrame:
    """T2 with several models (M14): every scorer adds its ``p_<name>``, each
    model is judged by its own stored threshold (``registry.thresholds``), and
    the first model of ``preference`` that gave a score decides. Adds the maps of
    all probabilities and predictions, band, model used and prediction time."""
    from riskframe.models.classifiers import multi_model

    out = stream
    for fn in scorers.values():
        out = fn(out)
    out = multi_model(out, list(scorers), thresholds, preference)
    none = F.col("model_used") == "none"
    return out.withColumns({"risk_level": F.when(none, F.lit("Error")).otherwise(X.risk_band("fraud_probability")),
                            "prediction_time": X.iso_now()})


def alerts(scored: DataFrame, cut: float = S.ALERT_CUT) -> DataFrame:
    """High-risk alerts (probability > cut), append-only."""
    return scored.filter(F.col("fraud_probability") > cut).select(
        "transaction_id", "fraud_probability", F.lit("HIGH").alias("severity"),
        F.concat(F.lit("High-risk transaction detected: "), X.fmt4("fraud_probability")).alias("message"))


def running_metrics(scored: DataFrame, measure: str = "Amount") -> DataFrame:
    """T4: processed, fraud detected, fraud % and running mean of a measure
    (one global streaming aggregate; state is a handful of numbers)."""
    g = scored.agg(F.count(F.lit(1)).alias("total_processed"),
                   F.sum(F.col("prediction").cast("long")).alias("fraud_detected"),
                   X.exact_sum(measure).alias("_sum"), F.count(X.known(measure)).alias("_n"))
    return g.select("total_processed", "fraud_detected",
                    (X.safe_ratio("fraud_detected", "total_processed") * 100.0).alias("fraud_rate_pct"),
                    F.try_divide(F.col("_sum"), F.col("_n")).alias(f"avg_{measure.lower()}"))


def rate_alerts(metrics: DataFrame, cut: float = S.RATE_ALERT_PCT) -> DataFrame:
    """``high_fraud_rate`` when the running fraud % (rounded to 3)
    exceeds ``cut``."""
    r = X.round3("fraud_rate_pct")
    return metrics.filter(r > cut).select(
        F.lit("high_fraud_rate").alias("type"), F.lit("high").alias("severity"),
        F.concat(F.lit("Fraud rate is "), r.cast("string"), F.lit("% - above threshold")).alias("message"))


def windowed_rates(scored: DataFrame, window: str = "1 day", watermark: str = "1 hour",
                   slide: str | None = None) -> DataFrame:
    """T7 (event time): per tumbling (or sliding) window fraud rate and mean
    probability, with a watermark bounding the state."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (scored.withWatermark("ts", watermark).groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("prediction").cast("double")).alias("fraud_rate"),
        X.exact_avg("fraud_probability").alias("avg_probability"))
        .select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "fraud_rate",
                "avg_probability"))


def recent_drift(predictions: DataFrame, n: int = 1000, n_windows: int = 10, order: str = "transaction_id",
                 change: float = S.DRIFT_CHANGE) -> DataFrame:
    """Alerts on the stream's last ``n`` predictions (its sink, or a
    micro-batch's rows joined to it): ten windows, the first against the last
    (D3/D4). Used from :func:`drift_alert_sink` after every micro-batch."""
    from riskframe.operators import drift as DR

    return DR.window_drift(DR.window_stats(predictions, n, n_windows, order), change)


def drift_alert_sink(predictions: str, alerts_path: str, n: int = 1000, n_windows: int = 10, change: float = S.DRIFT_CHANGE,
                     order: str = "transaction_id"):
    """foreachBatch sink for scored rows: stores the micro-batch's predictions
    and writes the drift alerts over the last ``n`` of the whole stream. The last
    ``n`` are merged state: those of the epoch before with the micro-batch's own,
    so an epoch reads no history. Each epoch has its own folder, so a retried
    epoch replaces itself."""
    from riskframe.streaming.epochs import EpochLog

    def sink(b: DataFrame, epoch: int, out: str) -> None:
        spark = b.sparkSession
        log = EpochLog(spark, f"{alerts_path}_last")
        newest, _ = log.newest()
        if epoch <= newest:
            return
        rows = b.select(order, "fraud_probability", "prediction")
        rows.write.mode("overwrite").parquet(epoch_dir(predictions, epoch))
        rows = spark.read.schema(rows.schema).parquet(epoch_dir(predictions, epoch))
        if newest >= 0:
            rows = rows.unionByName(log.read_newest("rows"))
        rows.orderBy(F.col(order).desc()).limit(n).write.mode("overwrite").parquet(log.folder("rows", epoch))
        recent = spark.read.parquet(log.folder("rows", epoch))
        recent_drift(recent, n, n_windows, order, change).write.mode("overwrite").parquet(epoch_dir(alerts_path, epoch))
        log.commit(epoch, {})
    return sink


def sessions(scored: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Session windows per customer (delivery plumbing for T4/T7); append
    mode: a session is emitted once the watermark passes its end."""
    return (scored.withWatermark("ts", watermark).groupBy("customer_id", F.session_window("ts", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("fraud_probability").alias("max_probability")))


def dedupe(stream: DataFrame, key: str = "transaction_id", watermark: str = "1 hour") -> DataFrame:
    """Drop repeated ids within the watermark (bounded state). Rows older
    than the watermark are dropped as late; Spark filters late rows with the
    watermark carried from the previous micro-batch, so a row becomes late
    one batch after the watermark has passed it."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def update_message(batch: DataFrame, totals: dict) -> DataFrame:
    """One JSON message per micro-batch (none for an empty one): its latest
    transaction, and the statistics of the whole stream up to and with it
    (``totals``: numbers of ``rows`` and ``fraud``)."""
    rate = round(totals["fraud"] / totals["rows"] * 100.0, 3) if totals["rows"] else 0.0
    latest = batch.orderBy(F.col("transaction_id").desc()).limit(1)
    stats = F.struct(F.lit(totals["rows"]).cast("long").alias("total_transactions"), F.lit(totals["fraud"]).cast("long").alias("fraud_count"),
                     F.lit(rate).alias("fraud_rate"))
    return latest.select(F.to_json(F.struct(
        F.lit("real_time_update").alias("type"),
        F.struct("transaction_id", "Amount", "fraud_probability", "risk_level").alias("transaction"), stats.alias("statistics"))).alias("message"))


# ---- running queries --------------------------------------------------------

def start(df: DataFrame, name: str, sink: str = "parquet", path: str | None = None, mode: str = "append",
          trigger: dict | None = None, foreach_batch=None, checkpoint: str | None = None,
          state_partitions: int | None = None, conf: dict | None = None) -> tuple[StreamingQuery, str]:
    """Start a query. Give ``path`` (the sink) and ``checkpoint`` (shared
    storage): started again with the same two, it resumes where it stopped, with
    its state, and repeats nothing. Without them both are new scratch folders
    under the shared folder, for a run that needn't be resumed. ``trigger`` e.g.
    ``{"processingTime": "100 milliseconds"}`` (T1) or ``{"availableNow":
    True}``. Returns (query, output path).

    A stateful query fixes its number of state partitions at its first start
    (kept in the checkpoint). ``state_partitions`` (default: the cluster's
    parallelism) sets it for this query only, as ``conf`` does other settings."""
    spark = df.sparkSession
    if state_partitions is None:
        state_partitions = spark.sparkContext.defaultParallelism
    out = path or scratch_path(spark, f"sink-{name}")
    w = df.writeStream.queryName(f"{name}_{uuid.uuid4().hex[:8]}").outputMode(mode).option(
        "checkpointLocation", checkpoint or scratch_path(spark, f"stream-{name}"))
    w = w.trigger(**(trigger or {"availableNow": True}))
    if foreach_batch is not None:
        w = w.foreachBatch(lambda b, i: foreach_batch(b, i, out))
    else:
        w = w.format(sink).option("path", out)
    want = {"spark.sql.shuffle.partitions": str(state_partitions), **(conf or {})}
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        q = w.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return q, out


def overwrite_batch(b: DataFrame, epoch: int, out: str) -> None:
    """foreachBatch sink for complete-mode results: the table as of this epoch,
    in a folder of its own, which replaces the one before once its manifest is
    there (:func:`read_table`). A reader never finds the table half written."""
    from riskframe.streaming.epochs import EpochLog

    log = EpochLog(b.sparkSession, out)
    newest, _ = log.newest()
    if epoch > newest:
        b.write.mode("overwrite").parquet(log.folder("table", epoch))
        log.commit(epoch, {})
        if newest >= 1:
            drop_path(b.sparkSession, log.folder("table", newest - 1))


def read_table(spark: SparkSession, out: str) -> DataFrame:
    """The newest table that :func:`overwrite_batch` has committed."""
    from riskframe.streaming.epochs import EpochLog

    return EpochLog(spark, out).read_newest("table")


def epoch_dir(out: str, epoch: int, name: str = "_epoch") -> str:
    """One folder per micro-batch: a retried epoch overwrites its own
    output, so foreachBatch writes are idempotent."""
    return f"{out}/{name}={epoch}"


def append_versioned(b: DataFrame, epoch: int, out: str) -> None:
    """foreachBatch sink for update-mode results: each epoch in its own
    folder (the ``_epoch`` column on read), so the newest row per key is the
    current value and a retried epoch replaces itself. :func:`compact` keeps
    the number of epochs small."""
    b.write.mode("overwrite").parquet(epoch_dir(out, epoch))


def compact(spark: SparkSession, out: str, keys: list[str]) -> None:
    """Fold all epochs of an ``append_versioned`` table into its newest one:
    the newest row of each key is written there and the older epochs are
    deleted. Run it while the query is stopped."""
    epochs = sorted(r[0] for r in spark.read.parquet(out).select(F.col("_epoch").cast("long")).distinct().collect())
    if len(epochs) < 2:
        return
    held, path = materialize(latest_per_key(spark, out, keys), "compact")
    held.write.mode("overwrite").parquet(epoch_dir(out, epochs[-1]))
    for e in epochs[:-1]:
        drop_path(spark, epoch_dir(out, e))
    drop_path(spark, path)


def latest_per_key(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Read an ``append_versioned`` table: newest row per key."""
    t = spark.read.parquet(out).withColumn("_epoch", F.col("_epoch").cast("long"))
    cols = [c for c in t.columns if c not in keys and c != "_epoch"]
    g = t.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_epoch").alias("_v"))
    return g.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in cols])


def run_to_table(df: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None,
                 trigger: dict | None = None, conf: dict | None = None) -> DataFrame:
    """Run a stream until the available input is consumed and return its
    result as a batch table (append: the sink; complete: the last table;
    update: the newest row per key)."""
    spark = df.sparkSession
    if mode == "complete":
        q, out = start(df, name, mode=mode, trigger=trigger, foreach_batch=overwrite_batch, conf=conf)
    elif mode == "update":
        q, out = start(df, name, mode=mode, trigger=trigger, foreach_batch=append_versioned, conf=conf)
    else:
        q, out = start(df, name, mode=mode, trigger=trigger, conf=conf)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if mode == "complete":
        return read_table(spark, out)
    if mode == "update":
        return latest_per_key(spark, out, keys or [])
    return spark.read.parquet(out)


def live_profiles(stream: DataFrame, key: str = "customer_id", amount: str = "Amount",
                  order: str = "transaction_id") -> DataFrame:
    """T5 with profiles kept current: each row gets its key's count and mean
    amount over all strictly earlier rows (by ``order``), from per-key state
    (rows, non-null amounts and their sum in millionths, three numbers a key)
    plus an in-batch prefix. Null and NaN amounts count as rows but not in the
    mean. The result does not depend on where micro-batches are cut (rows are
    assumed to arrive in ``order`` per key; a late row sees the state at
    arrival). Append mode: one output row per input row. One key's rows of a
    micro-batch are folded by one task, three numbers a row."""
    from pyspark.sql import types as T
    from pyspark.sql.streaming.state import GroupStateTimeout

    ktype, otype = stream.schema[key].dataType, stream.schema[order].dataType
    out = T.StructType([T.StructField(key, ktype), T.StructField(order, otype),
                        T.StructField("profile_tx_count", T.LongType()),
                        T.StructField("avg_amount_per_customer", T.DoubleType())])
    st = T.StructType([T.StructField("rows", T.LongType()), T.StructField("n", T.LongType()), T.StructField("units", T.LongType())])

    def fold(k, batches, state):
        import numpy as np
        import pandas as pd

        rows, n, total = state.get if state.exists else (0, 0, 0)
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        pdf = pd.concat(parts).sort_values(order)
        x = pd.to_numeric(pdf[amount]).to_numpy("float64", na_value=np.nan)
        known = ~np.isnan(x)
        units = np.where(known, np.round(np.where(known, x, 0.0) * 1e6), 0).astype("int64")
        prior_n = n + np.cumsum(known) - known
        prior = total + np.cumsum(units) - units
        with np.errstate(invalid="ignore", divide="ignore"):
            avg = np.where(prior_n > 0, prior / 1e6 / prior_n, np.nan)
        state.update((int(rows + len(pdf)), int(n + known.sum()), int(total + units.sum())))
        yield pd.DataFrame({key: pdf[key].to_numpy(), order: pdf[order].to_numpy(),
                            "profile_tx_count": rows + np.arange(len(pdf), dtype="int64"),
                            "avg_amount_per_customer": avg})

    return stream.select(key, order, amount).groupBy(key).applyInPandasWithState(
        fold, out, st, "append", GroupStateTimeout.NoTimeout)


def read_predictions(spark: SparkSession, path: str, limit: int = 100, order: str = "transaction_id") -> DataFrame:
    """Consume up to ``limit`` results in order."""
    return spark.read.parquet(path).orderBy(order).limit(limit)
