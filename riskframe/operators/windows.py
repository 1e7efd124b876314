"""Window-shaped operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions import scalars as X
from riskframe.operators import prefix


def last_n(df: DataFrame, n: int = 1000, order: str = "transaction_id") -> DataFrame:
    """The most recent ``n`` rows by ``order`` (TakeOrderedAndProject:
    each task keeps its own top ``n``, only those are merged)."""
    return df.orderBy(F.col(order).desc()).limit(n)


def split_windows(recent: DataFrame, n_windows: int = 10, order: str = "transaction_id") -> DataFrame:
    """Cut already-bounded recent rows (W3 output, at most N rows) into
    ``n_windows`` equal consecutive windows in ascending order; the
    remainder (``N mod n_windows`` newest rows) is dropped, as the
    reference's integer window length does. A plain window is fine here
    because the input is capped at N rows by construction."""
    total = recent.agg(F.count(F.lit(1))).scalar()
    length = F.floor(total / F.lit(n_windows))
    rn = F.row_number().over(Window.orderBy(F.col(order)))
    return (recent.withColumn("_rn", rn)
            .withColumn("window_id", F.floor((F.col("_rn") - 1) / length).cast("int"))
            .filter(F.col("window_id") < n_windows).drop("_rn"))


def chunk_by_position(df: DataFrame, batch_size: int = 1000, order=("transaction_id",),
                      name: str = "batch_id") -> DataFrame:
    """Consecutive chunks of ``batch_size`` rows in ``order``; the last
    chunk may be short. Position comes from the distributed prefix count."""
    ranked = prefix.global_rank(df, list(order), name="_pos")
    return (ranked.withColumn(name, F.floor((F.col("_pos") - 1) / batch_size).cast("long"))
            .drop("_pos"))


def cumulative_mean(df: DataFrame, value, order: list, name: str = "cumulative_mean") -> DataFrame:
    """Running mean of ``value`` over a global order, via distributed
    prefix sums (no single-partition window). Moves all columns of ``df``:
    select what is needed first."""
    v = F.col(value) if isinstance(value, str) else value
    out = prefix.running(df, order, {"_s": v, "_n": F.when(v.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))},
                         exact=True)
    return out.withColumn(name, F.try_divide(F.col("_s"), F.col("_n"))).drop("_s", "_n")


def quartile_labels(df: DataFrame, p: str = "fraud_probability", name: str = "risk_quartile",
                    tiebreak: str | None = "transaction_id") -> DataFrame:
    """Low/Medium/High/Critical by exact quartiles, right-closed edges
    (``p <= q1`` Low, ``<= q2`` Medium, ``<= q3`` High, else Critical).
    The quartiles are exact and distributed (three numbers, scalar
    subqueries). A row without a score (null, NaN) has no label."""
    from riskframe.operators import stats

    q = stats.exact_quantiles(df, p, [0.25, 0.5, 0.75], tiebreak=tiebreak)
    q1, q2, q3 = (q.select(c).scalar() for c in ("q_25", "q_50", "q_75"))
    c = X.known(p)
    return df.withColumn(name, F.when(c <= q1, "Low").when(c <= q2, "Medium")
                         .when(c <= q3, "High").when(c.isNotNull(), "Critical"))
