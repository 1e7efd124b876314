"""Exact, distributed order statistics.

Spark's exact ``percentile`` buffers every value of a group in one task; a
group that holds a third of the table would not fit. Over a whole table the
values at the quantiles' positions are selected by counting: a pass counts the
values of each bracket's equal subintervals (combined map-side, a fixed number of
rows), the subinterval that holds a position becomes its bracket, as narrow as its
content, and so on until a bracket holds one value or few enough to pick from.
Nothing is sorted or written, and a hot value is one bracket. Per group, values
are ranked with the distributed prefix count (range partitioning splits any
group). Both interpolate linearly (NumPy/pandas default, DuckDB ``quantile_cont``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators import prefix

#: subintervals of a bracket in a counting pass, and values that are picked from directly
SPLITS, FEW = 4096, 20_000


def values_at(df: DataFrame, value: str, positions: list[int], lo: float, hi: float) -> dict[int, float]:
    """The values at 0-based ``positions`` of the ascending order of a double
    column without nulls and NaN, whose finite ends are ``lo`` and ``hi``; infinities
    are counted with the ends. Jobs: one for each narrowing."""
    v = F.least(F.greatest(F.col(value), F.lit(lo)), F.lit(hi))
    rows = df.select(v.alias("v"))
    found: dict[int, float] = {}
    #: bracket -> positions relative to its first value
    todo = {(lo, hi): {p: p for p in positions}}
    while todo:
        for (a, b), at in [x for x in todo.items() if x[0][0] == x[0][1]]:
            found |= dict.fromkeys(at, a)
            del todo[a, b]
        if not todo:
            break
        brackets = sorted(todo)  # they don't overlap
        which = F.coalesce(*[F.when((F.col("v") >= a) & (F.col("v") <= b), F.lit(i)) for i, (a, b) in enumerate(brackets)])
        # halves, so that the width of any bracket is finite; monotone in v, as every step of it is
        part = [F.floor((F.col("v") / 2 - F.lit(a / 2)) / F.lit(b / 2 - a / 2) * SPLITS) if b / 2 > a / 2 else (F.col("v") > a).cast("long")
                for a, b in brackets]
        split = F.coalesce(*[F.when(F.col("i") == i, p) for i, p in enumerate(part)])
        counted = (rows.withColumn("i", which).where("i is not null").withColumn("s", split).groupBy("i", "s")
                   .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")))
        below = dict.fromkeys(range(len(brackets)), 0)
        next_todo: dict[tuple[float, float], dict[int, int]] = {}
        small = 0
        for r in sorted(counted.collect()):  # at most SPLITS + 1 rows a bracket
            first = below[r["i"]]
            below[r["i"]] = first + r["n"]
            inside = {p: q - first for p, q in todo[brackets[r["i"]]].items() if first <= q < first + r["n"]}
            if inside:
                next_todo[r["a"], r["b"]] = inside
                small += r["n"] if r["a"] < r["b"] else 0
        todo = next_todo
        if 0 < small <= FEW:
            some = [(a, b) for a, b in todo if a < b]
            near = rows.where(F.coalesce(*[F.when((F.col("v") >= a) & (F.col("v") <= b), True) for a, b in some], F.lit(False)))
            picked = sorted(r["v"] for r in near.collect())  # at most FEW
            for a, b in some:
                mine = [x for x in picked if a <= x <= b]
                found |= {p: mine[q] for p, q in todo.pop((a, b)).items()}
    return found


def table_quantiles(df: DataFrame, value: str, qs, names: list[str]) -> DataFrame:
    """One row with the quantiles ``qs`` of a column's known values (null if there are none)."""
    v = F.col(value).cast("double")
    rows = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    inf = F.lit(float("inf"))
    ends = F.when(F.abs("v") < inf, F.col("v"))
    n, lo, hi, under, over = rows.agg(F.count(F.lit(1)), F.min(ends), F.max(ends), F.count_if(F.col("v") == -inf), F.count_if(F.col("v") == inf)).first()
    need = {}
    for q in qs:
        h = (n - 1) * float(q)
        need[q] = (int(h // 1), int(-(-h // 1)), h - h // 1)
    places = sorted({p for a, b, _ in need.values() for p in (a, b)}) if n else []
    got = {p: float("-inf") if p < under else float("inf") for p in places if p < under or p >= n - over}
    inner = [p for p in places if p not in got]
    if inner:
        got |= values_at(rows, "v", inner, lo, hi)
    out = [None if not n else got[a] if f == 0 or got[a] == got[b] else got[a] + (got[b] - got[a]) * f for a, b, f in need.values()]
    return df.sparkSession.createDataFrame([tuple(out)], ", ".join(f"`{c}` double" for c in names))


def exact_quantiles(df: DataFrame, value: str, qs, by: list[str] | None = None,
                    tiebreak: str | None = None, prefix_name: str = "q") -> DataFrame:
    """One row per group (or one row) with ``<prefix_name>_<pct>`` columns.

    ``tiebreak``: a unique column to make the ranking order total per group (equal
    values give equal results either way; it keeps a hot value splittable).
    """
    by = list(by or [])
    if not by:
        return table_quantiles(df, value, qs, [_column(prefix_name, q) for q in qs])
    v = F.col(value)
    base = df.select(*by, v.cast("double").alias("_v"), *([tiebreak] if tiebreak else [])).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    counts = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    # place within the group: a running count that restarts with it
    ranked = prefix.running(base, ["_v", *([tiebreak] if tiebreak else [])], {"_r": F.lit(1.0)}, by=by)
    keys = counts.withColumnsRenamed({b: f"_b_{b}" for b in by})
    same = [ranked[b].eqNullSafe(keys[f"_b_{b}"]) for b in by]
    ranked = ranked.join(keys, same, "inner").drop(*[f"_b_{b}" for b in by])
    ranked = ranked.withColumn("_pos", F.col("_r").cast("long") - 1)  # 0-based in group
    keep = None
    cols = []
    for q in qs:
        h = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.floor(h), F.ceil(h)
        cond = (F.col("_pos") == lo) | (F.col("_pos") == hi)
        keep = cond if keep is None else keep | cond
        cols.append((q, h, lo, hi))
    picked = ranked.filter(keep)
    aggs = []
    for q, h, lo, hi in cols:
        vlo = F.max(F.when(F.col("_pos") == lo, F.col("_v")))
        vhi = F.max(F.when(F.col("_pos") == hi, F.col("_v")))
        frac = F.max(h - lo)
        aggs.append((vlo + (vhi - vlo) * frac).alias(_column(prefix_name, q)))
    return picked.groupBy(*by).agg(*aggs)


def _column(prefix_name: str, q: float) -> str:
    return f"{prefix_name}_{round(q * 100, 4):g}".replace(".", "_")


def describe(df: DataFrame, value: str, by: list[str] | None = None, tiebreak: str | None = None) -> DataFrame:
    """pandas ``describe()``: count, mean, sample std, min, 25/50/75 %, max."""
    by = list(by or [])
    v = F.col(value).cast("double")
    moments = (df.groupBy(*by) if by else df).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    qs = exact_quantiles(df, value, [0.25, 0.5, 0.75], by=by, tiebreak=tiebreak, prefix_name="p")
    qs = qs.withColumnsRenamed({"p_25": "p25", "p_50": "p50", "p_75": "p75"})
    if by:
        qs = qs.withColumnsRenamed({b: f"_b_{b}" for b in by})
        same = [moments[b].eqNullSafe(qs[f"_b_{b}"]) for b in by]
        return moments.join(qs, same, "left").drop(*[f"_b_{b}" for b in by])
    return moments.withColumns({c: qs.select(c).scalar() for c in ("p25", "p50", "p75")})
