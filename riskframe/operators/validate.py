"""Schema checks, row validation and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe import schema as S


def missing_columns(df: DataFrame, required=S.REQUIRED_COLUMNS) -> list[str]:
    """P1 (plan time): required names absent from the schema."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required=S.REQUIRED_COLUMNS) -> DataFrame:
    """Raise naming the missing columns, else return ``df``."""
    miss = missing_columns(df, required)
    if miss:
        raise ValueError(f"Missing required columns: {miss}")
    return df


def with_violations(df: DataFrame, required=("Time", "Amount"), non_negative=("Amount", "Time")) -> DataFrame:
    """A ``violations`` array per row: ``missing:<c>`` for null,
    ``non_numeric:<c>`` when a present value does not parse as a number
    (``try_cast``), ``negative:<c>`` for the non-negative fields."""
    checks = []
    for c in required:
        if c not in df.columns:
            checks.append(F.lit(f"missing:{c}"))
            continue
        col = F.col(c)
        num = F.expr(f"try_cast(`{c}` AS DOUBLE)")
        checks.append(F.when(col.isNull(), F.lit(f"missing:{c}")))
        checks.append(F.when(col.isNotNull() & num.isNull(), F.lit(f"non_numeric:{c}")))
        if c in non_negative:
            checks.append(F.when(num < 0, F.lit(f"negative:{c}")))
    arr = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.withColumn("violations", arr)


def split_valid(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with their violations)."""
    v = with_violations(df, **kw)
    return (v.filter(F.size("violations") == 0).drop("violations"),
            v.filter(F.size("violations") > 0))


def violation_summary(df: DataFrame, **kw) -> DataFrame:
    """P3 report: rows per violation kind plus the count of valid rows."""
    v = with_violations(df, **kw)
    kinds = F.when(F.size("violations") == 0, F.array(F.lit("valid"))).otherwise(F.col("violations"))
    return v.select(F.explode(kinds).alias("violation")).groupBy("violation").agg(
        F.count(F.lit(1)).alias("n"))


def fill_defaults(df: DataFrame, defaults=S.CATEGORY_DEFAULTS) -> DataFrame:
    """Optional categorical fields take their defaults when null or
    absent."""
    out = df
    for c, d in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(d))
    return out


def split_target(df: DataFrame, target: str = "Class") -> tuple[DataFrame, DataFrame]:
    """(features without target, target). Raises if the target is absent."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found in dataset")
    return df.drop(target), df.select(target)


def numeric_columns(df: DataFrame, exclude=("Class", *S.CATEGORICAL_COLUMNS)) -> list[str]:
    """Numeric columns by type, minus target and categoricals."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def select_features(df: DataFrame, feature_columns: list[str]) -> DataFrame:
    """The stored feature list, in order."""
    return df.select(*feature_columns)


def display_columns(df: DataFrame, wanted: dict[str, str], digits: int = 4) -> DataFrame:
    """Keep the wanted columns that exist, rename them, round doubles."""
    present = [c for c in wanted if c in df.columns]
    types = dict(df.dtypes)
    return df.select(*[(F.round(c, digits) if types[c] in ("double", "float") else F.col(c)).alias(wanted[c])
                       for c in present])


def sample_rows(df: DataFrame, n: int, seed: int = 42, id_col: str = "transaction_id") -> DataFrame:
    """``n`` rows without replacement (all rows when fewer), chosen by
    an md5 of (id, seed): deterministic, order-free, and a top-k plan."""
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(key, F.col(id_col)).limit(n)


def derive_if_absent(df: DataFrame, derivations: dict) -> DataFrame:
    """Add each derived column only if the frame lacks it."""
    out = df
    for c, e in derivations.items():
        if c not in out.columns:
            out = out.withColumn(c, e)
    return out
