"""Feature engineering: time parts, customer and merchant profiles, trailing
velocity, null filling (F1-F2, A3-A4, J1-J4, W1-W2, P5-P6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import scalars as X
from riskframe.operators import prefix


def time_features(df: DataFrame, time_col: str = "Time", unit: str = "seconds") -> DataFrame:
    """``hour_of_day`` and ``day_of_week`` from the offset column."""
    return df.withColumns({"hour_of_day": X.hour_of_day(time_col, unit),
                           "day_of_week": X.day_of_week(time_col, unit)})


def customer_profile(df: DataFrame, key: str = "customer_id", amount: str = "Amount") -> DataFrame:
    """A3: per-customer mean amount and row count. A hash aggregate with a
    map-side partial step, so a hot customer is combined before the shuffle."""
    return df.groupBy(key).agg(X.exact_avg(amount).alias("avg_amount_per_customer"),
                               F.count(F.lit(1)).alias("tx_count"))


def merchant_profile(df: DataFrame, key: str = "merchant_id", label: str = "Class") -> DataFrame:
    """A4: per-merchant label rate."""
    return df.groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("merchant_fraud_rate"))


def attach(df: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """Left equi-join of a one-row-per-key profile onto every row.

    No broadcast hint: the profile grows with the number of keys. AQE turns
    it into a broadcast join when its runtime size is under the threshold and
    otherwise keeps a sort-merge join whose skewed partitions it splits.
    """
    return df.join(profile, key, "left")


def group_stats_to_rows(df: DataFrame, key: str, aggs: dict) -> DataFrame:
    """A group aggregate broadcast back to its rows.

    Planned as aggregate + join rather than ``agg().over(partitionBy(key))``:
    the window form sorts a whole group inside one task, which a key holding
    a third of the rows would overload; the aggregate pre-combines map-side.
    """
    prof = df.groupBy(key).agg(*[e.alias(n) for n, e in aggs.items()])
    return attach(df, prof, key)


def trailing_count(df: DataFrame, key: str = "customer_id", time_col: str = "Time",
                   seconds: int = 86400, name: str = "tx_freq_24h") -> DataFrame:
    """Rows of the same key with time in ``[t - seconds, t]`` (inclusive,
    equal times included), i.e. ``COUNT(*) OVER (PARTITION BY key ORDER BY t
    RANGE BETWEEN seconds PRECEDING AND CURRENT ROW)``: rows without a time
    count the rows of their key without one.

    A window per key would put a hot key into one task. The count depends on
    (key, time) only, so the rows are first counted by these (combined
    map-side); each pair then marks its end ``t`` with its count and its start
    ``t - seconds`` with nothing, and a distributed running sum over (key, time,
    start before end) gives ``cum(end) - cum(start)``. That narrow table is
    joined back; the wide rows are shuffled for that join only, and a hot
    key's rows are spread over its times."""
    pairs = df.groupBy(F.col(key).alias("_k"), F.col(time_col).cast("double").alias("_t")).agg(F.count(F.lit(1)).alias("_w"))
    known = pairs.where("_t is not null")
    ends = known.select("_k", F.col("_t").alias("_at"), F.lit(1).alias("_end"), "_w", "_t")
    starts = known.select("_k", (F.col("_t") - float(seconds)).alias("_at"), F.lit(0).alias("_end"), F.lit(0).cast("long").alias("_w"), "_t")
    marks = prefix.running(ends.unionByName(starts), ["_k", "_at", "_end", "_t"], {"_c": "_w"})
    count = marks.groupBy("_k", "_t").agg(F.sum(F.when(F.col("_end") == 1, F.col("_c")).otherwise(-F.col("_c"))).cast("long").alias(name))
    count = count.unionByName(pairs.where("_t is null").select("_k", "_t", F.col("_w").alias(name)))
    same = df[key].eqNullSafe(count["_k"]) & df[time_col].cast("double").eqNullSafe(count["_t"])
    return df.join(count, same, "left").drop("_k", "_t")


def earlier_rate(df: DataFrame, key: str = "merchant_id", time_col: str = "Time", label: str = "Class",
                 name: str = "merchant_fraud_rate") -> DataFrame:
    """Leak-free label rate: for each row the rate over the labelled rows of its
    key with a strictly earlier time (rows of the same time, its own included, don't
    count); null before the first. Rows without a time see none.

    The rate depends on (key, time) only: labels are added up by these (combined
    map-side), a distributed running sum over the order (key, time) gives what lies
    before, and that narrow table is joined back. A hot key's times are spread over
    ranges like any others."""
    k, t = F.col(key).alias("_k"), F.col(time_col).cast("double").alias("_t")
    y = F.col(label).cast("double")
    pairs = df.groupBy(k, t).agg(F.count(y).alias("_n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("_y")).where("_t is not null and not isnan(_t)")
    upto = prefix.running(pairs, ["_t"], {"_cn": "_n", "_cy": "_y"}, by=["_k"])
    before = upto.select("_k", "_t", F.try_divide(F.col("_cy") - F.col("_y"), F.col("_cn") - F.col("_n")).alias(name))
    same = df[key].eqNullSafe(before["_k"]) & (df[time_col].cast("double") == before["_t"])
    return df.drop(name).join(before, same, "left").drop("_k", "_t")


def fill_feature_nulls(df: DataFrame, amount: str = "Amount", mean_source: DataFrame | None = None) -> DataFrame:
    """P5: merchant rate -> 0, customer average -> global mean Amount
    (a scalar subquery), frequency -> 1."""
    src = mean_source if mean_source is not None else df
    g = src.agg(X.exact_avg(amount)).scalar()
    out = df
    if "merchant_fraud_rate" in df.columns:
        out = out.withColumn("merchant_fraud_rate", F.coalesce("merchant_fraud_rate", F.lit(0.0)))
    if "avg_amount_per_customer" in df.columns:
        out = out.withColumn("avg_amount_per_customer", F.coalesce("avg_amount_per_customer", g))
    if "tx_freq_24h" in df.columns:
        out = out.withColumn("tx_freq_24h", F.coalesce("tx_freq_24h", F.lit(1).cast("long")))
    return out


def engineer_features(df: DataFrame, unit: str = "seconds", freq: str = "trailing",
                      fit_df: DataFrame | None = None, label: str = "Class", rate: str = "profile") -> DataFrame:
    """The reference's feature step, Spark-first.

    * ``unit``: ``seconds`` (correct) or ``reference`` (Time read as hours).
    * ``freq``: ``trailing`` (24 h window, W2) or ``reference`` (all rows of
      the customer, A3's count).
    * ``fit_df``: rows the profiles are computed from. ``None`` uses ``df``
      itself (the reference fits before its split and leaks labels); pass the
      training rows to avoid that.
    * ``rate``: ``profile`` (the merchant's rate in ``fit_df``) or ``earlier`` (over
      the merchant's strictly earlier rows of ``df``, :func:`earlier_rate`).
    P6: absent id columns fall back to global values (scalar subqueries).
    """
    fit = fit_df if fit_df is not None else df
    out = time_features(df, unit=unit)
    if "customer_id" in df.columns:
        cp = customer_profile(fit)
        if freq == "reference":
            cp = cp.withColumnRenamed("tx_count", "tx_freq_24h")
        else:
            cp = cp.drop("tx_count")
        out = attach(out, cp, "customer_id")
        if freq != "reference":
            out = trailing_count(out)
    else:
        out = out.withColumns({"avg_amount_per_customer": fit.agg(X.exact_avg("Amount")).scalar(),
                               "tx_freq_24h": F.lit(1).cast("long")})
    if rate == "earlier" and "merchant_id" in df.columns and label in df.columns:
        out = earlier_rate(out, label=label)
    elif "merchant_id" in df.columns and label in fit.columns:
        out = attach(out, merchant_profile(fit, label=label), "merchant_id")
    elif label in fit.columns:
        out = out.withColumn("merchant_fraud_rate", fit.agg(F.avg(F.col(label).cast("double"))).scalar())
    else:
        out = out.withColumn("merchant_fraud_rate", F.lit(None).cast("double"))
    return fill_feature_nulls(out, mean_source=fit)


def profile_features(df: DataFrame, fit_df: DataFrame, unit: str = "seconds", label: str = "Class") -> DataFrame:
    """Features for scoring, batch or streaming: time parts, and per-customer
    and per-merchant profiles fitted on ``fit_df`` (history) attached by
    left joins (stream-static joins on a stream). A ``tx_freq_24h`` that the
    rows have (``streaming.velocity.trailing_count_stream``: the trailing count that
    models are trained on) stays; without one it is the customer's history count.
    Fill values are literals computed once from the history (two numbers), so the
    plan has no subquery."""
    cp = customer_profile(fit_df).withColumnRenamed("tx_count", "tx_freq_24h")
    if "tx_freq_24h" in df.columns:
        cp = cp.drop("tx_freq_24h")
    mp = merchant_profile(fit_df, label=label)
    mean_amount, = fit_df.agg(X.exact_avg("Amount")).first()
    out = attach(attach(time_features(df, unit=unit), cp, "customer_id"), mp, "merchant_id")
    return out.withColumns({
        "avg_amount_per_customer": F.coalesce("avg_amount_per_customer", F.lit(mean_amount)),
        "tx_freq_24h": F.coalesce("tx_freq_24h", F.lit(1).cast("long")),
        "merchant_fraud_rate": F.coalesce("merchant_fraud_rate", F.lit(0.0))})


def align_on_id(left: DataFrame, right: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Pair predictions with labels/values by id (the reference zips by
    position, which a distributed table does not have)."""
    return left.join(right, key, "inner")
