"""One pass, many sinks (C6, S8, T4, T6, T7, T9): an epoch's output becomes
visible in all sinks at once, or not at all.

Every sink writes an epoch into a folder of its own (``<sink>/_epoch=<n>``); the
epoch counts once its manifest, one small file written beside and renamed into
``_commits``, is there. Readers take the epochs up to the newest manifest: after a
crash between two sinks they see the epoch before, and the retried epoch
overwrites its half-written folders. The manifest also carries the running totals
and which folders hold the mergeable state, so an epoch costs what its own rows
cost, however long the stream has run.
"""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from riskframe.functions import scalars as X
from riskframe.operators import drift as DR
from riskframe.operators import report as R
from riskframe.session import drop_path, scratch_path
from riskframe.streaming import stream as SS


class EpochLog:
    """The manifests of the epochs written under ``base`` (any file system that
    Spark reads)."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._dir = f"{self.base}/_commits"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self) -> list[int]:
        """Epochs whose manifest is still kept, ascending."""
        fs, p = self._fs(self._dir)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def newest(self) -> tuple[int, dict]:
        """The newest epoch and its manifest; (-1, {}) before the first."""
        done = self.committed()
        if not done:
            return -1, {}
        fs, p = self._fs(f"{self._dir}/{done[-1]}.json")
        f = fs.open(p)
        try:
            return done[-1], json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8"))
        finally:
            f.close()

    def commit(self, epoch: int, manifest: dict, keep: int = 3) -> None:
        """Make ``epoch`` the newest one. Of older manifests the last ``keep`` stay."""
        fs, tmp = self._fs(f"{self._dir}/_{epoch}.tmp")
        f = fs.create(tmp, True)
        f.write(bytearray(json.dumps(manifest).encode()))
        f.close()
        if not fs.rename(tmp, self._fs(f"{self._dir}/{epoch}.json")[1]):
            raise RuntimeError(f"epoch {epoch} could not be committed under {self.base}")
        for old in self.committed()[:-keep]:
            fs.delete(self._fs(f"{self._dir}/{old}.json")[1], False)

    def folder(self, sink: str, epoch: int) -> str:
        return SS.epoch_dir(f"{self.base}/{sink}", epoch)

    def read(self, sink: str) -> DataFrame:
        """All committed rows of an appended sink, with ``_epoch``."""
        newest, _ = self.newest()
        return self.spark.read.parquet(f"{self.base}/{sink}").where(F.col("_epoch") <= newest)

    def read_newest(self, sink: str) -> DataFrame:
        """A replaced sink as of the newest epoch."""
        newest, _ = self.newest()
        return self.spark.read.parquet(self.folder(sink, newest))


def _merged_totals(held: DataFrame, before: dict, measure: str) -> dict:
    """Running totals after this micro-batch: four mergeable numbers."""
    row = held.agg(F.count(F.lit(1)), F.sum(F.col("prediction").cast("long")), F.sum(X.finite(measure).cast(X.EXACT)),
                   F.count(X.finite(measure))).first()
    return {"rows": before.get("rows", 0) + row[0], "fraud": before.get("fraud", 0) + (row[1] or 0),
            "sum": str(Decimal(before.get("sum", "0")) + (row[2] or 0)), "known": before.get("known", 0) + row[3]}


def _metrics(spark: SparkSession, totals: dict, measure: str) -> DataFrame:
    """T4's row from the totals."""
    mean = float(Decimal(totals["sum"]) / totals["known"]) if totals["known"] else None
    pct = totals["fraud"] / totals["rows"] * 100.0 if totals["rows"] else 0.0
    return spark.createDataFrame([(totals["rows"], totals["fraud"], pct, mean)],
                                 f"total_processed long, fraud_detected long, fraud_rate_pct double, avg_{measure.lower()} double")


def scoring_sink(base: str, buffer_key: str | None = "merchant_id", buffer_size: int = 1000, last: int = 1000,
                 n_windows: int = 10, change: float = 0.1, fold_every: int = 16, measure: str = "Amount",
                 order: str = "transaction_id", between=None):
    """foreachBatch sink for scored rows: the micro-batch is held once and
    written as predictions, alerts (T3), running metrics (T4), update message
    (T9), the last ``last`` rows of the stream and their drift (T7), and the last
    ``buffer_size`` rows of every ``buffer_key`` (T6), all under one manifest.

    The last rows merge: those of the stream with the micro-batch's own, those of
    a key when :func:`read_buffer` reads them, from at most ``fold_every`` folders,
    which are then folded into one. ``between`` is called after each sink (tests
    crash there)."""
    mark = between or (lambda sink: None)

    def sink(b: DataFrame, epoch: int, _out: str) -> None:
        spark = b.sparkSession
        log = EpochLog(spark, base)
        newest, state = log.newest()
        if epoch <= newest:
            return  # committed before; the query was stopped before it noted so
        held = b.persist(StorageLevel.MEMORY_AND_DISK)

        def write(df: DataFrame, what: str) -> None:
            df.write.mode("overwrite").parquet(log.folder(what, epoch))
            mark(what)

        try:
            write(held.select(order, "fraud_probability", "risk_level", "prediction"), "predictions")
            write(SS.alerts(held), "alerts")
            totals = _merged_totals(held, state.get("totals", {}), measure)
            write(_metrics(spark, totals, measure), "metrics")
            write(SS.update_message(held, totals), "updates")
            recent = held.select(order, "fraud_probability", "prediction")
            if newest >= 0:
                recent = recent.unionByName(spark.read.parquet(log.folder("recent", newest)))
            write(recent.orderBy(F.col(order).desc()).limit(last), "recent")
            kept = spark.read.parquet(log.folder("recent", epoch))
            write(DR.window_drift(DR.window_stats(kept, last, n_windows, order), change), "drift")
            live = [*state.get("buffer", []), epoch]
            if buffer_key:
                rows = held.select(buffer_key, order, "fraud_probability", "prediction")
                seen = rows.groupBy(buffer_key).agg(F.count(F.lit(1)).alias("seen"))
                if len(live) > fold_every:
                    rows, seen = _live(log, live[:-1], buffer_key, rows, seen)
                    live = [epoch]
                write(R.top_per_group(rows, buffer_key, order, buffer_size, order), "buffer")
                write(seen, "seen")
            log.commit(epoch, {"totals": totals, "buffer": live, "key": buffer_key, "size": buffer_size, "windows": n_windows,
                               "order": order})
            for what in ("metrics", "recent"):  # replaced: the epoch before stays for readers that began earlier
                if newest >= 1:
                    drop_path(spark, log.folder(what, newest - 1))
        finally:
            held.unpersist()
    return sink


def _live(log: EpochLog, live: list[int], key: str, rows: DataFrame | None = None, seen: DataFrame | None = None):
    """Rows and row counts of a buffer's folders (and of those given)."""
    old = log.spark.read.parquet(*[log.folder("buffer", e) for e in live])
    n = log.spark.read.parquet(*[log.folder("seen", e) for e in live])
    n = n if seen is None else n.unionByName(seen)
    return (old if rows is None else old.unionByName(rows)), n.groupBy(key).agg(F.sum("seen").alias("seen"))


def read_buffer(spark: SparkSession, base: str) -> DataFrame:
    """T6 from the committed epochs: per key what ``state.last_n_buffer`` gives."""
    log = EpochLog(spark, base)
    _, state = log.newest()
    key, order, n, windows = state["key"], state["order"], state["size"], state["windows"]
    rows, seen = _live(log, state["buffer"], key)
    rows = R.top_per_group(rows, key, order, n, order)
    w = Window.partitionBy(key)  # at most n rows of a key
    rows = rows.withColumns({"_i": F.row_number().over(w.orderBy(F.asc_nulls_first(order))) - 1, "_n": F.count(F.lit(1)).over(w)})
    length = F.floor(F.col("_n") / windows)
    y = F.col("prediction").cast("double")
    out = rows.groupBy(key).agg(
        F.count(F.lit(1)).cast("int").alias("buffered"), F.avg(y).alias("fraud_rate"), F.avg(X.known("fraud_probability")).alias("avg_probability"),
        F.avg(F.when(F.col("_i") < length, y)).alias("first_window_rate"),
        F.avg(F.when((F.col("_i") >= (windows - 1) * length) & (F.col("_i") < windows * length), y)).alias("last_window_rate"))
    seen = seen.withColumnRenamed(key, "_key")
    return out.join(seen, out[key].eqNullSafe(seen["_key"])).select(
        key, "seen", "buffered", "fraud_rate", "avg_probability", "first_window_rate", "last_window_rate")


def start_scoring(scored: DataFrame, base: str | None = None, trigger: dict | None = None, checkpoint: str | None = None,
                  **sink) -> tuple[StreamingQuery, EpochLog]:
    """One streaming query over scored rows with all sinks under ``base`` (a
    shared folder; started again with it, the query resumes). Returns the query and
    the log to read from. ``sink``: options of :func:`scoring_sink`."""
    spark = scored.sparkSession
    base = (base or scratch_path(spark, "scoring")).rstrip("/")
    q, _ = SS.start(scored, "scoring", path=base, checkpoint=checkpoint or f"{base}/_checkpoint", trigger=trigger,
                    foreach_batch=scoring_sink(base, **sink))
    return q, EpochLog(spark, base)
