"""Scalar column functions (F1-F15). All are built-in Catalyst expressions,
so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe import schema as S

__all__ = [
    "hour_of_day", "day_of_week", "risk_band", "anomaly_flag_to_probability",
    "threshold_classify", "minmax_normalise", "weighted_score", "safe_ratio",
    "merchant_status", "drift_severity", "fmt4", "fmt_pct2", "default_tx_id",
    "iso_now", "category_text", "round3", "round6", "col_", "known", "finite", "exact_sum", "exact_avg",
]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour_of_day(time_col="Time", unit: str = "seconds") -> Column:
    """F1. ``unit='seconds'``: hour of the offset ``floor(Time/3600) mod 24``.
    ``unit='reference'``: the reference's ``int(Time % 24)`` (treats seconds
    as hours)."""
    t = col_(time_col)
    if unit == "reference":
        return F.pmod(F.floor(t), F.lit(24)).cast("int")
    return F.pmod(F.floor(t / 3600.0), F.lit(24)).cast("int")


def day_of_week(time_col="Time", unit: str = "seconds") -> Column:
    """F2. ``floor(Time/86400) mod 7``; reference mode ``int((Time//24) % 7)``."""
    t = col_(time_col)
    if unit == "reference":
        return F.pmod(F.floor(t / 24.0), F.lit(7)).cast("int")
    return F.pmod(F.floor(t / 86400.0), F.lit(7)).cast("int")


def risk_band(p="fraud_probability", high: float = S.HIGH_CUT, medium: float = S.MEDIUM_CUT) -> Column:
    """F3. Strict cut-offs: > high -> High, > medium -> Medium, else Low. NaN
    and null are not scores: their band is ``Error`` (M15)."""
    p = col_(p)
    return (F.when(F.isnan(p) | p.isNull(), F.lit("Error"))
            .when(p > high, F.lit("High"))
            .when(p > medium, F.lit("Medium"))
            .otherwise(F.lit("Low")))


def anomaly_flag_to_probability(flag) -> Column:
    """F4. Anomaly flag -1 -> 0.9, anything else -> 0.1."""
    return F.when(col_(flag) == -1, F.lit(0.9)).otherwise(F.lit(0.1))


def threshold_classify(p, threshold, strict: bool = False) -> Column:
    """F5. ``p >= t`` for classifiers, ``p > t`` (strict) for anomaly scores."""
    p, t = col_(p), (threshold if isinstance(threshold, Column) else F.lit(threshold))
    return ((p > t) if strict else (p >= t)).cast("int")


def minmax_normalise(s, lo, hi, invert: bool = False) -> Column:
    """F6. ``(s-min)/(max-min)``, or ``1-`` that when inverted. A zero range
    yields null instead of a division error; ``lo``/``hi`` are columns
    (e.g. scalar subqueries) or numbers."""
    s = col_(s)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    z = (s - lo) / F.nullif(hi - lo, F.lit(0.0))
    return (F.lit(1.0) - z) if invert else z


def weighted_score(cols, weights=S.ENSEMBLE_WEIGHTS) -> Column:
    """F7. Weighted combination of score columns."""
    out = None
    for c, w in zip(cols, weights):
        term = col_(c) * F.lit(float(w))
        out = term if out is None else out + term
    return out


def safe_ratio(num, den) -> Column:
    """F8. ``num/den``, 0 when the denominator is 0 or null."""
    return F.coalesce(F.try_divide(col_(num).cast("double"), col_(den).cast("double")), F.lit(0.0))


def merchant_status(score, review: float = 0.7, monitor: float = 0.6) -> Column:
    """F9. Review / Monitor / Normal by merchant risk score (cut-offs inferred);
    null for a merchant without a score."""
    s = known(score)
    return (F.when(s >= review, F.lit("Review"))
            .when(s >= monitor, F.lit("Monitor")).when(s.isNotNull(), F.lit("Normal")))


def drift_severity(change, high: float = S.DRIFT_HIGH) -> Column:
    """F10. HIGH when the absolute change exceeds ``high``, else MEDIUM; null
    for an unknown change."""
    c = known(change)
    return F.when(c > high, F.lit("HIGH")).when(c.isNotNull(), F.lit("MEDIUM"))


def fmt4(x) -> Column:
    """F11. Four decimals. Rounded as an exact decimal (half up), so the
    text does not depend on the binary error of the double."""
    return F.round(col_(x).cast("decimal(38,10)"), 4).cast("decimal(38,4)").cast("string")


def fmt_pct2(x) -> Column:
    """F11. A fraction as percent with two decimals, e.g. 0.1234 -> 12.34%."""
    return F.concat(F.round((col_(x) * 100.0).cast("decimal(38,10)"), 2).cast("decimal(38,2)").cast("string"),
                    F.lit("%"))


def default_tx_id(id_col, position=None) -> Column:
    """F12. The id as text; ``tx_<position>`` when missing and a position is
    known, else ``unknown``."""
    fallback = F.lit("unknown") if position is None else F.concat(F.lit("tx_"), col_(position).cast("string"))
    return F.coalesce(col_(id_col).cast("string"), fallback)


def iso_now() -> Column:
    """F13. Current time as ISO-8601 text (kept out of compared output)."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def category_text(c) -> Column:
    """F14. Category cast to text; null becomes the text ``nan`` as pandas'
    ``astype(str)`` does."""
    return F.coalesce(col_(c).cast("string"), F.lit("nan"))


def round3(x) -> Column:
    """F15."""
    return F.round(col_(x), 3)


def round6(x) -> Column:
    return F.round(col_(x), 6)


#: wide enough that a double of ordinary size (below 1e20) keeps its digits
EXACT = "decimal(38,18)"


def known(x) -> Column:
    """``x``, null where it is NaN: a missing value, as the null profile counts it."""
    c = col_(x)
    return F.when(~F.isnan(c.cast("double")), c)


def finite(x) -> Column:
    """``x``, null where it is NaN or infinite."""
    c = col_(x)
    return F.when(F.abs(c.cast("double")) < F.lit(float("inf")), c)


def exact_sum(x) -> Column:
    """Sum over an 18-decimal fixed point, returned as double: independent of
    order and partitioning, and no coarser than the doubles it sums. NaN is
    missing; infinities carry (both signs: NaN)."""
    d = col_(x).cast("double")
    ends = F.sum(F.when(F.abs(d) == F.lit(float("inf")), d))
    return F.coalesce(ends, F.sum(finite(x).cast(EXACT)).cast("double"))


def exact_avg(x) -> Column:
    """Mean of the known values from :func:`exact_sum` (null for none)."""
    return exact_sum(x) / F.count(known(x))
