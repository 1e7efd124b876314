"""Scored-table analytics: batch summaries, breakdowns, KPIs, merchant and
volume reports, top-k (A9-A10, A14-A21, K1-K6, U1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions import scalars as X


def with_band(df: DataFrame, p: str = "fraud_probability", name: str = "risk_level") -> DataFrame:
    """F3 as a column."""
    return df.withColumn(name, X.risk_band(p))


def batch_summary(banded: DataFrame, by: str | None = "batch_id", band: str = "risk_level") -> DataFrame:
    """Per batch total, High/Medium/Low counts and fraud rate as the
    High share (a fraction; 0 for an empty batch). Rows banded ``Error``
    count in the total only."""
    b = F.col(band)
    aggs = [F.count(F.lit(1)).alias("total_transactions"),
            F.count_if(b == "High").alias("high_risk_count"),
            F.count_if(b == "Medium").alias("medium_risk_count"),
            F.count_if(b == "Low").alias("low_risk_count")]
    g = banded.groupBy(by).agg(*aggs) if by else banded.agg(*aggs)
    return g.withColumn("fraud_rate", X.safe_ratio("high_risk_count", "total_transactions"))


def rollup_batches(summary: DataFrame) -> DataFrame:
    """Roll batch summaries up to totals."""
    g = summary.agg(F.count(F.lit(1)).alias("batches"),
                    F.sum("total_transactions").alias("total_transactions"),
                    F.sum("high_risk_count").alias("high_risk_count"),
                    F.sum("medium_risk_count").alias("medium_risk_count"),
                    F.sum("low_risk_count").alias("low_risk_count"))
    return g.withColumn("fraud_rate", X.safe_ratio("high_risk_count", "total_transactions"))


def risk_by(df: DataFrame, dim: str, p: str = "fraud_probability", label: str = "Class") -> DataFrame:
    """Mean risk score and fraud count per ``dim``."""
    return df.groupBy(dim).agg(X.exact_avg(p).alias("avg_risk_score"),
                               F.sum(F.col(label).cast("long")).alias("fraud_count"))


def kpis(df: DataFrame, leaderboard: DataFrame | None = None, label: str = "Class") -> DataFrame:
    """Total, fraud % and the best model's precision with its recall
    (K4 over the leaderboard); both null when no leaderboard is given."""
    base = df.agg(F.count(F.lit(1)).alias("total_transactions"),
                  (X.safe_ratio(F.sum(label), F.count(F.lit(1))) * 100.0).alias("fraud_rate_pct"))
    if leaderboard is None:
        return base.withColumns({c: F.lit(None).cast("double") for c in ("precision", "recall")})
    best = best_model(leaderboard)
    return base.withColumns({"precision": best.select("precision").scalar(),
                             "recall": best.select("recall").scalar()})


def amount_buckets(df: DataFrame, amount: str = "Amount") -> DataFrame:
    """Counts in fixed amount buckets 0-50, 50-100, 100-200, 200-500, 500+;
    rows without an amount (null, NaN) are ``unknown``."""
    a = X.known(amount)
    e = S.AMOUNT_EDGES
    lab = (F.when(a < e[1], S.AMOUNT_LABELS[0]).when(a < e[2], S.AMOUNT_LABELS[1])
           .when(a < e[3], S.AMOUNT_LABELS[2]).when(a < e[4], S.AMOUNT_LABELS[3])
           .when(a.isNotNull(), S.AMOUNT_LABELS[4]).otherwise(F.lit("unknown")))
    return df.groupBy(lab.alias("amount_range")).agg(F.count(F.lit(1)).alias("n"))


def activity_counts(df: DataFrame, dims=("hour_of_day", "day_of_week", "transaction_type",
                                          "card_type", "region", "channel")) -> DataFrame:
    """Counts per value of each dimension in one scan (GROUPING SETS),
    long format (dimension, value, n)."""
    present = [d for d in dims if d in df.columns]
    cube = df.select(*[F.col(d).cast("string").alias(d) for d in present])
    g = cube.groupingSets([[d] for d in present], *present).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in present])
    dim = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in present])
    val = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d)) for d in present])
    return g.select(dim.alias("dimension"), val.alias("value"), "n")


def merchant_risk(df: DataFrame, p: str = "fraud_probability", label: str = "Class",
                  review: float = 0.7, monitor: float = 0.6) -> DataFrame:
    """Per merchant mean score, transactions, fraud rate and status."""
    g = df.groupBy("merchant_id").agg(X.exact_avg(p).alias("risk_score"),
                                      F.count(F.lit(1)).alias("transactions"),
                                      F.avg(F.col(label).cast("double")).alias("fraud_rate"))
    return g.withColumn("status", X.merchant_status("risk_score", review, monitor))


def merchant_overview(merchants: DataFrame, high: float = 0.7) -> DataFrame:
    """A19 header: merchant count, high-risk merchant count, mean risk."""
    return merchants.agg(F.count(F.lit(1)).alias("merchants"),
                         F.count_if(F.col("risk_score") >= high).alias("high_risk_merchants"),
                         F.round(F.avg("risk_score"), 6).alias("avg_risk_score"))



def top_risk_merchants(merchants: DataFrame, k: int = 5) -> DataFrame:
    """K6: top-k merchants by risk score (ties by id)."""
    return merchants.orderBy(F.col("risk_score").desc(), F.col("merchant_id")).limit(k)


def daily_volume(df: DataFrame, p: str = "fraud_probability", threshold: float = 0.5) -> DataFrame:
    """Per day volume, average of the known amounts, peak hour (most transactions,
    earliest hour on ties) and blocked amount (sum of predicted-fraud
    amounts)."""
    day = F.date_format("ts", "yyyy-MM-dd")
    money = X.finite("Amount").cast(X.EXACT)
    hourly = df.groupBy(day.alias("day"), F.hour("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("hn"), F.sum(money).alias("ha"), F.count(money).alias("hk"),
        F.sum(F.when(F.col(p) >= threshold, money).otherwise(F.lit(0).cast(X.EXACT))).alias("hb"))
    return hourly.groupBy("day").agg(
        F.sum("hn").alias("volume"),
        F.try_divide(F.sum("ha").cast("double"), F.sum("hk")).alias("avg_amount"),
        F.min_by("hour", F.struct(-F.col("hn"), F.col("hour"))).alias("peak_hour"),
        F.sum("hb").cast("double").alias("blocked_amount"))


def running_totals(df: DataFrame, pred: str = "prediction") -> DataFrame:
    """Transactions, frauds, fraud % rounded to 3."""
    g = df.agg(F.count(F.lit(1)).alias("total_transactions"),
               F.sum(F.col(pred).cast("long")).alias("fraud_detected"))
    return g.withColumn("fraud_rate_pct", X.round3(X.safe_ratio("fraud_detected", "total_transactions") * 100.0))


def high_risk_rows(df: DataFrame, p: str = "fraud_probability", cut: float = S.DASHBOARD_HIGH,
                   k: int = 10, id_col: str = "transaction_id") -> DataFrame:
    """P10 + K1: rows with score > cut, the first ``k`` by score desc, id."""
    return df.filter(F.col(p) > cut).orderBy(F.col(p).desc(), F.col(id_col)).limit(k)


def best_model(leaderboard: DataFrame) -> DataFrame:
    """K4: the model with the highest precision; the first listed wins ties."""
    order = [F.col("precision").desc()]
    if "model_order" in leaderboard.columns:
        order.append(F.col("model_order"))
    order.append(F.col("model"))
    return leaderboard.orderBy(*order).limit(1)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def top_per_group(df: DataFrame, group: str, score: str, k: int, id_col: str) -> DataFrame:
    """K6 per group: the ``k`` highest scores inside each group. Spark limits
    each group map-side first (``WindowGroupLimit``, partial), so a hot group
    sends at most ``k`` rows from each task."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(id_col))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
