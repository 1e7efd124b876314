"""Profiling: nulls, summary, value counts, distinct counts, two-level
describes, histograms, box statistics, correlations (P2, A1-A8, A11-A13,
A22). Every operator is one or two scans with map-side partial aggregation."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import scalars as X
from riskframe.operators import stats


def null_profile(df: DataFrame, only_positive: bool = True) -> DataFrame:
    """Null count per column in one aggregate, unpivoted with ``stack``."""
    aggs = [F.count_if(F.col(c).isNull() | (F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False)))
            .alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    long = wide.selectExpr(f"stack({len(df.columns)}, {pairs}) as (column_name, null_count)")
    return long.filter(F.col("null_count") > 0) if only_positive else long


def dataset_summary(df: DataFrame, label: str = "Class", amount: str = "Amount",
                    tiebreak: str | None = "transaction_id") -> DataFrame:
    """A1: rows, columns, class counts, fraud rate in percent, Amount mean,
    sample std, min, max, exact median."""
    a = X.known(amount)
    base = df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(F.col(label) == 0).alias("normal_count"),
                  F.count_if(F.col(label) == 1).alias("fraud_count"),
                  F.round(X.safe_ratio(F.sum(label), F.count(F.lit(1))) * 100.0, 6).alias("fraud_rate_pct"),
                  X.exact_avg(a).alias("amount_mean"),
                  F.round(F.stddev_samp(a), 6).alias("amount_std"),
                  F.min(a).alias("amount_min"), F.max(a).alias("amount_max"))
    med = stats.exact_quantiles(df, amount, [0.5], tiebreak=tiebreak if tiebreak in df.columns else None)
    return base.withColumns({"columns": F.lit(len(df.columns)),
                             "amount_median": F.round(med.select("q_50").scalar(), 6)})


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A2: count per value (descending count is the presentation order)."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), F.col("value"))


def distinct_counts(df: DataFrame, cols=("customer_id", "merchant_id"), approx: bool = False) -> DataFrame:
    """A5: distinct values per column (exact: two-phase distinct aggregate;
    ``approx``: HyperLogLog++)."""
    f = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[f(c).alias(f"distinct_{c}") for c in cols])


def group_size_describe(df: DataFrame, keys=("customer_id", "merchant_id", "hour_of_day")) -> DataFrame:
    """Size of each group, then describe() of the sizes, one row per key."""
    from riskframe.operators.report import union_all

    outs = []
    for k in keys:
        sizes = df.groupBy(k).agg(F.count(F.lit(1)).alias("size"))
        d = stats.describe(sizes, "size", tiebreak=k)
        outs.append(d.withColumn("grouping", F.lit(k)))
    return _round_describe(union_all(outs))


def group_rate_describe(df: DataFrame, keys=("merchant_id", "customer_id"), label: str = "Class") -> DataFrame:
    """Label rate per group, then describe() of the rates."""
    from riskframe.operators.report import union_all

    outs = []
    for k in keys:
        rates = df.groupBy(k).agg(F.avg(F.col(label).cast("double")).alias("rate"))
        outs.append(stats.describe(rates, "rate", tiebreak=k).withColumn("grouping", F.lit(k)))
    return _round_describe(union_all(outs))


def _round_describe(df: DataFrame) -> DataFrame:
    return df.select("grouping", "count", *[F.round(c, 6).alias(c) for c in
                                            ("mean", "std", "min", "p25", "p50", "p75", "max")])


def time_span_days(df: DataFrame, time_col: str = "Time") -> DataFrame:
    """(max - min) / 86400."""
    return df.agg(F.round((F.max(time_col) - F.min(time_col)) / 86400.0, 6).alias("time_span_days"))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram (NumPy edges: ``bins`` equal steps from min
    to max, last bin closed) of the finite values. min/max are scalar
    subqueries; only non-empty bins are returned."""
    v = X.finite(F.col(col).cast("double"))
    lo = df.agg(F.min(v)).scalar()
    hi = df.agg(F.max(v)).scalar()
    width = (hi - lo) / F.lit(float(bins))
    idx = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((v - lo) * (F.lit(float(bins)) / (hi - lo))), F.lit(bins - 1))).cast("int")
    g = df.filter(v.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("bin", F.round(lo + F.col("bin") * width, 6).alias("lower"),
                    F.round(lo + (F.col("bin") + 1) * width, 6).alias("upper"), "n")


def box_stats(df: DataFrame, value: str, by: str = "Class", tiebreak: str | None = "transaction_id") -> DataFrame:
    """Per group (the null group too) quartiles, IQR, 1.5 IQR whiskers (most extreme values
    inside the fences) and outlier count; NaN is missing."""
    tb = tiebreak if tiebreak in df.columns else None
    q = stats.exact_quantiles(df, value, [0.25, 0.5, 0.75], by=[by], tiebreak=tb)
    q = q.withColumnRenamed(by, "_by")
    rows = df.select(by, X.known(F.col(value).cast("double")).alias("_v"))
    j = rows.join(q, rows[by].eqNullSafe(q["_by"]), "inner").drop("_by")
    iqr = F.col("q_75") - F.col("q_25")
    lo_f, hi_f = F.col("q_25") - 1.5 * iqr, F.col("q_75") + 1.5 * iqr
    g = j.groupBy(by, "q_25", "q_50", "q_75").agg(
        F.min(F.when(F.col("_v") >= lo_f, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(F.col("_v") <= hi_f, F.col("_v"))).alias("whisker_high"),
        F.count_if((F.col("_v") < lo_f) | (F.col("_v") > hi_f)).alias("outliers"))
    return g.select(by, *[F.round(c, 6).alias(n) for c, n in
                          (("q_25", "q1"), ("q_50", "median"), ("q_75", "q3"))],
                    F.round(F.col("q_75") - F.col("q_25"), 6).alias("iqr"),
                    F.round("whisker_low", 6).alias("whisker_low"),
                    F.round("whisker_high", 6).alias("whisker_high"), "outliers")


def corr_matrix(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation of every pair, long format (col_a, col_b, corr)
    including the diagonal and both orders; null for a constant column. Rows
    with a null in any of the columns are left out. One distributed pass
    (MLlib's Gramian); the result has columns x columns numbers."""
    cols = list(cols)
    whole = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    vec = VectorAssembler(inputCols=[f"c{i}" for i in range(len(cols))], outputCol="v").transform(whole).select("v")
    if vec.limit(2).count() < 2:
        matrix = [[math.nan] * len(cols) for _ in cols]
    else:
        matrix = Correlation.corr(vec, "v", "pearson").first()[0].toArray().tolist()
    rows = [(a, b, 1.0 if i == j else (None if math.isnan(matrix[i][j]) else round(matrix[i][j], 6)))
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


def class_balance(df: DataFrame, label: str = "Class") -> DataFrame:
    """Normal vs fraud counts; rows without a label are ``unknown``."""
    name = F.when(F.col(label) == 1, F.lit("fraud")).when(F.col(label).isNull(), F.lit("unknown")).otherwise(F.lit("normal"))
    return df.groupBy(name.alias("class_name")).agg(F.count(F.lit(1)).alias("n"))
