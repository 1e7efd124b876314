"""Mergeable sketches of distinct counts and distributions.

A batch (a day, an hour) is summarised once: rows, a HyperLogLog sketch for each
distinct count, a KLL sketch for each distribution, all built-in aggregates with
map-side partials. The summaries are stored, a few kilobytes a batch, and any
longer period's figures come from merging them: the rows are not read again. A
batch that is stored again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions import scalars as X

#: relative standard error of a distinct count about 1.04 / 2^(HLL / 2), of a rank about 2.3 / KLL
HLL, KLL = 12, 400


def summarise(df: DataFrame, by: list[str], distinct: list[str], values: list[str]) -> DataFrame:
    """One row per batch (the columns ``by``): ``rows``, ``hll_<column>`` and
    ``kll_<column>``. Nulls are no value, nor is NaN."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *[F.hll_sketch_agg(c, HLL).alias(f"hll_{c}") for c in distinct],
        *[F.kll_sketch_agg_double(X.finite(F.col(c).cast("double")), KLL).alias(f"kll_{c}") for c in values])


def store(summary: DataFrame, path: str, batch: str) -> None:
    """Keep the summaries of one run under ``path``; the same ``batch`` again replaces it."""
    summary.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def rollup(summary: DataFrame, by: list, quantiles=(0.25, 0.5, 0.75)) -> DataFrame:
    """Merged summaries per period (columns or names ``by``; none: one row):
    ``rows``, ``distinct_<column>``, and ``q_<pct>_<column>`` (null where a
    distribution is empty)."""
    hll = [c for c in summary.columns if c.startswith("hll_")]
    kll = [c for c in summary.columns if c.startswith("kll_")]
    g = summary.groupBy(*by).agg(F.sum("rows").alias("rows"), *[F.hll_union_agg(c).alias(c) for c in hll],
                                 *[F.kll_merge_agg_double(c).alias(c) for c in kll])
    out = [c for c in g.columns if c not in (*hll, *kll)]
    out += [F.hll_sketch_estimate(c).alias(f"distinct_{c[4:]}") for c in hll]
    for c in kll:
        some = F.kll_sketch_get_n_double(c) > 0
        out += [F.when(some, F.kll_sketch_get_quantile_double(c, F.lit(float(q)))).alias(f"q_{round(q * 100, 4):g}_{c[4:]}".replace(".", "_"))
                for q in quantiles]
    return g.select(*out)
