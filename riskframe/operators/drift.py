"""Drift detection.

* D1 ADWIN: the sequential detector's first detection, by histograms that are
  folded block by block (``operators.adwin``); the streaming form is in
  ``streaming.state``.
* D2 Page-Hinkley (Page 1954) with a forgetting factor, over one set of ranges.
* D3/D4 rate and mean-probability drift between the first and last of ten
  windows over the most recent N predictions.
* D5 an alert log is a union of alert tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions import scalars as X
from riskframe.operators import adwin
from riskframe.operators import windows as WN
from riskframe.operators.prefix import Ranges

def adwin_cuts(df: DataFrame, value: str = "Amount", time_col: str = "Time", delta: float = 0.002, min_window: int = 5,
               id_col: str = "transaction_id") -> DataFrame:
    """Every cut that the sequential detector would test up to the end of
    the table (see :func:`riskframe.operators.adwin.adwin_cuts`). Rows are taken by
    time, equal times by ``id_col`` (where there is one) and value."""
    return adwin.adwin_cuts(df, value, [time_col, *([id_col] if id_col in df.columns else [])], delta, min_window)


def adwin_alert(df: DataFrame, value: str = "Amount", time_col: str = "Time", delta: float = 0.002, min_window: int = 5,
                id_col: str = "transaction_id") -> DataFrame:
    """At most one alert, where the sequential detector first finds a drift
    (the reference stops at its first detection per batch); of its cuts the one
    furthest beyond its bound is reported. ``cut_time`` is the time of the last
    row before the change, ``detected_time`` of the last row seen."""
    order = [time_col, *([id_col] if id_col in df.columns else [])]
    first = adwin.first_drift(df, value, order, delta=delta, min_window=min_window)
    return first.select(F.lit("ADWIN").alias("type"), F.lit("High").alias("severity"),
                        F.lit(S.ADWIN_MESSAGE).alias("message"), F.col("mu0").alias("old_value"), F.col("mu1").alias("new_value"),
                        "cut_time", F.col("end_time").alias("detected_time"))


def page_hinkley(df: DataFrame, x, order: list, delta: float = 0.005, threshold: float = 50.0,
                 min_instances: int = 30, alpha: float = S.PH_ALPHA) -> DataFrame:
    """Page-Hinkley statistics per row of a global order, up to the first
    detection and beyond (no reset; :func:`page_hinkley_alert` takes the first,
    where the reference stops).

    ``m_t = alpha * m_{t-1} + (x_t - mean_t - delta)`` (increase) and
    ``u_t = alpha * u_{t-1} + (mean_t - x_t - delta)`` (decrease), with
    ``mean_t`` the running mean; the statistic is the distance from their
    running minimum; drift when it exceeds ``threshold`` after
    ``min_instances`` rows. All passes share one set of ranges: select the order
    and value columns first."""
    xv = F.col(x) if isinstance(x, str) else x
    r = Ranges(df.withColumn("_x", xv.cast("double")), order)
    a = r.running(r.rows, {"_t": F.lit(1.0), "_sx": F.col("_x")}, exact=True)
    a = a.withColumn("_xbar", F.col("_sx") / F.col("_t"))
    up, down = F.col("_x") - F.col("_xbar") - F.lit(delta), F.col("_xbar") - F.col("_x") - F.lit(delta)
    if alpha == 1.0:
        b = r.running(a, {"ph_m": up, "ph_u": down})
    else:
        b = r.deal(r.decayed(a, {"ph_m": up, "ph_u": down}, alpha))
    c = r.running(b, {"_minm": F.col("ph_m"), "_minu": F.col("ph_u")}, ops={"_minm": "min", "_minu": "min"})
    stat_up = F.col("ph_m") - F.col("_minm")
    stat_down = F.col("ph_u") - F.col("_minu")
    return c.withColumns({
        "t": F.col("_t").cast("long"), "ph_up": stat_up, "ph_down": stat_down,
        "drift": (F.col("_t") >= min_instances) & ((stat_up > threshold) | (stat_down > threshold)),
    }).drop("_t", "_sx", "_xbar", "_minm", "_minu", "_x", "_pid", "_loc")


def page_hinkley_alert(ph: DataFrame) -> DataFrame:
    """D2 alert: the first row that drifts."""
    first = ph.filter("drift").orderBy("t").limit(1)
    return first.select(F.lit("PageHinkley").alias("type"), F.lit("Medium").alias("severity"),
                        F.lit(S.PH_MESSAGE).alias("message"),
                        F.lit(None).cast("double").alias("old_value"), F.lit(None).cast("double").alias("new_value"),
                        "t")


def window_stats(df: DataFrame, n: int = 1000, n_windows: int = 10, order: str = "transaction_id",
                 pred: str = "prediction", prob: str = "fraud_probability") -> DataFrame:
    """W3 + W4: the last ``n`` rows, ten equal windows, per window rate of
    ``pred == 1`` and mean probability. Empty when fewer than ``n`` rows."""
    recent = WN.last_n(df.select(order, pred, prob), n, order)
    enough = df.select(F.count(F.lit(1))).scalar() >= n
    wins = WN.split_windows(recent.filter(enough), n_windows, order)
    return wins.groupBy("window_id").agg(
        F.avg((F.col(pred) == 1).cast("double")).alias("fraud_rate"),
        X.exact_avg(prob).alias("avg_probability"), F.count(F.lit(1)).alias("n"))


def window_drift(stats: DataFrame, change: float = S.DRIFT_CHANGE) -> DataFrame:
    """Compare the first and last window; alert when the absolute
    change exceeds ``change`` (severity by F10)."""
    g = stats.agg(F.min_by("fraud_rate", "window_id").alias("r0"), F.max_by("fraud_rate", "window_id").alias("r1"),
                  F.min_by("avg_probability", "window_id").alias("p0"),
                  F.max_by("avg_probability", "window_id").alias("p1"),
                  F.count(F.lit(1)).alias("windows"))
    rate = g.filter(F.col("windows") >= 2).select(
        F.lit("Fraud Rate Drift").alias("type"), F.abs(F.col("r1") - F.col("r0")).alias("chg"),
        F.col("r0").alias("old_value"), F.col("r1").alias("new_value"), F.lit("Fraud rate").alias("_what"))
    prob = g.filter(F.col("windows") >= 2).select(
        F.lit("Probability Drift").alias("type"), F.abs(F.col("p1") - F.col("p0")).alias("chg"),
        F.col("p0").alias("old_value"), F.col("p1").alias("new_value"), F.lit("Average probability").alias("_what"))
    both = rate.unionByName(prob).filter(F.col("chg") > change)
    return both.select("type", X.drift_severity("chg").alias("severity"),
                       F.concat(F.col("_what"), F.lit(" changed by "), X.fmt_pct2("chg")).alias("message"),
                       "old_value", "new_value")


def alert_log(*alerts: DataFrame) -> DataFrame:
    """Accumulate alert tables (union by name) and count per type."""
    from riskframe.operators.report import union_all

    log = union_all(list(alerts))
    return log.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))
