"""Batch ADWIN (Bifet & Gavalda 2007) over a whole table: the sequential
detector's first detection, found in parallel.

The detector keeps an exponential histogram of the values seen: grains of
``grain`` values, of which the two oldest of a size merge when there are more
than ``per_level`` of that size. Until its first detection nothing is dropped,
so the histogram after ``T`` grains depends on ``T`` alone: level ``l`` (``2^l``
grains) has been handed ``M_l = max(0, floor((T + q) / 2^l) - q)`` buckets with ``q
= per_level - 1``, the first ``2 M_(l+1)`` of which have moved on. Its bounds are
places in the order of the values, not in time, so a stray timestamp moves no
bucket.

That makes the histograms mergeable. Rows are ranked in order by the distributed
prefix count and added up by grain (n, sum, sum of squares: combined map-side, 32
times fewer); prefix sums over the grains give what lies before every place. Blocks
of grains are then folded side by side: a block needs its own prefix sums and, of
all earlier data, those at the bounds that its histograms reach back to, a number
that grows with the logarithm of the table (the carry). All cuts of all
histograms are tested; nothing is capped or sampled.

Values are taken relative to the first one, so that large amounts with a small
spread keep their variance; sums are doubles and don't overflow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import scalars as X
from riskframe.operators import prefix

#: values in the smallest bucket, and buckets of one size
GRAIN, PER_LEVEL = 32, 5
#: grains that one task folds at a time (four numbers each, but some hundred cuts), and ends whose cuts are tested at a time
BLOCK, ENDS = 1 << 12, 1 << 10

_CUTS = "end long, cut long, n0 long, n1 long, mu0 double, mu1 double, eps double, drift boolean, cut_time double, end_time double"


def handed(t, level: int, per_level: int = PER_LEVEL):
    """Buckets of ``2^level`` grains made so far after ``t`` grains (numbers or arrays)."""
    q = per_level - 1
    return np.maximum(0, ((t + q) >> level) - q)


def levels(t: int) -> int:
    """Levels that a histogram of ``t`` grains may have."""
    return max(1, int(t).bit_length())


def histogram_bounds(t: int, per_level: int = PER_LEVEL) -> list[int]:
    """Inner bounds of the histogram after ``t`` grains, in grains, ascending."""
    out = set()
    for lv in range(levels(t)):
        lo, hi = 2 * int(handed(t, lv + 1, per_level)), int(handed(t, lv, per_level))
        out |= {j << lv for j in range(lo, hi + 1)}
    return sorted(x for x in out if 0 < x < t)


def grain_sums(df: DataFrame, value: str, order: list[str], grain: int = GRAIN) -> tuple[DataFrame, float]:
    """Prefix sums at the end of every whole grain: (c, s, ss, t) for ``c``
    grains, with sums of the differences from the first value and the grain's
    last order value; and that first value. Rows without a finite value or a
    first order value don't count."""
    v, t = X.finite(F.col(value).cast("double")), F.col(order[0]).cast("double")
    rows = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], v.alias("_v"), t.alias("_t"))
    rows = rows.where(F.col("_v").isNotNull() & F.col("_t").isNotNull() & ~F.isnan("_t"))
    keys = [f"_o{i}" for i in range(len(order))] + ["_v"]
    first = rows.orderBy(*keys).limit(1).select("_v").first()
    base = float(first[0]) if first else 0.0
    ranked = prefix.global_rank(rows, keys, name="_r")
    d = F.col("_v") - F.lit(base)
    grains = (ranked.groupBy(F.floor((F.col("_r") - 1) / grain).alias("g"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("ds"), F.sum(d * d).alias("dss"), F.max("_t").alias("t"))
              .where(F.col("n") == grain))  # the last, unfinished grain is not tested
    summed = prefix.running(grains.select("g", "ds", "dss", "t"), ["g"], {"s": "ds", "ss": "dss"})
    return summed.select((F.col("g") + 1).alias("c"), "s", "ss", "t"), base


def _fold(pdf: pd.DataFrame, base: float, grain: int, per_level: int, delta: float, min_window: int, every: bool) -> pd.DataFrame:
    """The cuts of one block's histograms, all of them or those of its first
    drifting one. ``own`` rows are the block's; the others the bounds before it."""
    pdf = pdf.drop_duplicates("c").sort_values("c")
    ends = pdf["c"].to_numpy()[pdf["own"].to_numpy()]
    found = []
    for k in range(0, len(ends), ENDS):
        cuts = _cuts_at(pdf, ends[k:k + ENDS], base, grain, per_level, delta, min_window, every)
        found += [cuts] if len(cuts) else []
        if found and not every:
            break
    out = pd.concat(found) if found else pd.DataFrame(columns=[f.split(" ")[0] for f in _CUTS.split(", ")])
    return out if every or not len(out) else out[out["end"] == out["end"].min()]


def _cuts_at(pdf: pd.DataFrame, ends: np.ndarray, base: float, grain: int, per_level: int, delta: float, min_window: int, every: bool) -> pd.DataFrame:
    """The cuts of the histograms at ``ends``, or only those that drift; ``pdf`` by ``c``."""
    at, s, ss, when = (pdf[k].to_numpy() for k in ("c", "s", "ss", "t"))
    i = np.searchsorted(at, ends)
    n, total, squares = ends * float(grain), s[i], ss[i]
    var = np.maximum(0.0, squares / n - (total / n) ** 2)
    with np.errstate(divide="ignore"):
        d = np.log(2.0 * np.log(n) / delta)
    found = []
    for lv in range(levels(int(ends.max()))):
        lo, hi = 2 * handed(ends, lv + 1, per_level), handed(ends, lv, per_level)
        for k in range(int((hi - lo).max()) + 1):
            cut = (lo + k) << lv
            # a level's last bound is the next finer one's first
            ok = (lo + k <= hi) & (cut > 0) & (cut < ends) & ((lo + k < hi) | (lv == 0) | (hi == lo))
            if not ok.any():
                continue
            e, c = np.flatnonzero(ok), cut[ok]
            j = np.searchsorted(at, c)
            n0 = c * float(grain)
            n1 = n[e] - n0
            mu0, mu1 = s[j] / n0, (total[e] - s[j]) / n1
            m = 1.0 / n0 + 1.0 / n1
            eps = np.sqrt(2.0 * m * var[e] * d[e]) + 2.0 / 3.0 * d[e] * m
            wide = (n0 >= min_window) & (n1 >= min_window)
            drift = np.abs(mu0 - mu1) > eps
            keep = wide if every else wide & drift
            found.append(pd.DataFrame({"end": ends[e], "cut": c, "n0": n0.astype("int64"), "n1": n1.astype("int64"), "mu0": mu0 + base,
                                       "mu1": mu1 + base, "eps": eps, "drift": drift, "cut_time": when[j], "end_time": when[i[e]]})[keep])
    return pd.concat(found).drop_duplicates(["end", "cut"]) if found else pd.DataFrame()


def adwin_cuts(df: DataFrame, value: str = "Amount", order: list[str] | None = None, delta: float = 0.002, min_window: int = 5,
               grain: int = GRAIN, per_level: int = PER_LEVEL, block: int = BLOCK, every: bool = True) -> DataFrame:
    """Cuts of the histogram after every whole grain (``end`` and ``cut`` in
    grains): sizes and means of both sides, the test ``|mu0 - mu1| > eps`` with ``eps =
    sqrt(2 m v d) + 2/3 d m``, ``m = 1/n0 + 1/n1``, ``d = ln(2 ln(n)/delta)`` and v the
    variance of all n values, and the order values at the cut and the end.
    ``every=False``: of each block only its first ``end`` with drifting cuts, and
    those."""
    if block & (block - 1):
        raise ValueError("block must be a power of two")
    sums, base = grain_sums(df, value, order or ["Time"], grain)
    number = F.floor((F.col("c") - 1) / block)
    own = sums.select(number.alias("b"), F.lit(True).alias("own"), "c", "s", "ss", "t")
    # the bounds before a block that any of its histograms has, level by level
    spans = own.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("b > 0")
    q = per_level - 1
    lv = F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("hi") + 1.0)).cast("int"))).alias("lv")
    spans = spans.select("b", "lo", "hi", lv)

    def made(t: str, more: int = 0) -> str:
        return f"greatest(0L, shiftright({t} + {q}, lv + {more}) - {q})"

    reach = spans.select("b", "lv", F.expr(f"2 * {made('lo', 1)}").alias("j0"),
                         F.expr(f"least({made('hi')}, shiftright(lo - 1, lv))").alias("j1")).where("j1 >= j0")
    reach = reach.select("b", F.explode(F.sequence("j0", "j1")).alias("j"), "lv")
    reach = reach.select("b", F.expr("shiftleft(j, lv)").alias("c")).where("c > 0").distinct()
    carry = reach.join(sums, "c").select("b", F.lit(False).alias("own"), "c", "s", "ss", "t")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return _fold(pdf, base, grain, per_level, delta, min_window, every)

    return own.unionByName(carry).groupBy("b").applyInPandas(fold, _CUTS)


def first_drift(df: DataFrame, value: str = "Amount", order: list[str] | None = None, **kw) -> DataFrame:
    """At most one row of :func:`adwin_cuts`: the first end that drifts, and of
    its cuts the one furthest beyond its bound."""
    cuts = adwin_cuts(df, value, order, every=False, **kw)
    beyond = F.round(F.abs(F.col("mu0") - F.col("mu1")) - F.col("eps"), 9)
    return cuts.orderBy("end", beyond.desc(), "cut").limit(1)
