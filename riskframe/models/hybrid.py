"""Hybrid labels (M11) and boosted trees trained on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators import stats


def anomaly_cut(train_scores: DataFrame, prob: str, q: float = 0.95, id_col: str = "transaction_id"):
    """K5: the training ``q`` quantile of the anomaly probability (exact,
    distributed); returns a scalar column."""
    return stats.exact_quantiles(train_scores, prob, [q], tiebreak=id_col).select(
        f"q_{round(q * 100, 4):g}".replace(".", "_")).scalar()


def hybrid_labels(df: DataFrame, prob: str, cut, label: str = "Class", name: str = "hybrid_label") -> DataFrame:
    """Label OR (anomaly probability strictly above the cut). The test
    side is labelled with the *training* cut, as in the reference."""
    return df.withColumn(name, F.greatest(F.col(label).cast("int"), (F.col(prob) > cut).cast("int")))
