"""Global running aggregates without a single-partition window.

A window with an ``ORDER BY`` and no ``PARTITION BY`` moves every row into one
task. Here the rows are range-partitioned on the (total) order instead, so a
hot value is split across tasks like any other range, sorted, and written once
to the shared checkpoint folder, cut into blocks of at most ``BLOCK_ROWS`` rows:
the block's number (``_pid``) ascends with the order, ``_loc`` is the row's place
in it. That fixes the blocks, cuts the lineage and survives executor loss. Running
sums and extremes are then ordinary windows over ``_pid`` on the JVM, and one row
per block (a narrow table: the rows over ``BLOCK_ROWS``) carries the offsets. The
blocks are dealt to a fixed number of tasks, one block each on average: a shuffle
that is left to adaptive execution would be coalesced to its advisory size, which
is millions of narrow rows. What a task holds thus doesn't grow with the table, even
where a range comes out long. Several passes share one set of blocks.

Only the columns of the frame that is passed in are moved: callers select the
order, an id and the values, not whole rows. Building a :class:`Ranges` runs a
job (the write).
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.scalars import EXACT
from riskframe.session import ensure_checkpoint_dir, materialize

_OPS = {"sum": F.sum, "min": F.min, "max": F.max}
#: stored bytes of a range: columnar files of narrow rows take some 20 bytes a row, so 128 MiB would be millions of rows for one task
TARGET_PARTITION_BYTES = 8 * 1024 * 1024
#: rows of a block as a power of two: what a window or a Python task holds at a time
BLOCK_BITS = 17
BLOCK_ROWS = 1 << BLOCK_BITS


def auto_partitions(df: DataFrame, target: int = TARGET_PARTITION_BYTES) -> int:
    """Range partitions for ``df``: the size of the tables it reads (leaves of
    the optimised plan; a join's own estimate is a product and useless here)
    over ``target``. Where a leaf has no estimate, the session's shuffle partitions."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = 0
    for i in range(leaves.size()):
        one = int(str(leaves.apply(i).stats().sizeInBytes()))
        if one >= 1 << 60:  # no statistics
            return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        size += one
    return max(1, -(-size // target))


class Ranges:
    """``df`` in blocks of a total ``order``, written once. ``rows`` has its
    columns plus ``_pid`` and ``_loc`` and is dealt to tasks by block; ``stored``
    has the same rows as they were written."""

    def __init__(self, df: DataFrame, order: list, partitions: int | None = None):
        ensure_checkpoint_dir(df.sparkSession)
        ordered = df.repartitionByRange(partitions or auto_partitions(df), *order).sortWithinPartitions(*order)
        # partition number in the high bits, place in the partition in the low 33: its blocks' numbers follow each other
        mid = F.monotonically_increasing_id()
        self.stored, self.path = materialize(
            ordered.withColumns({"_pid": F.shiftright(mid, BLOCK_BITS), "_loc": mid.bitwiseAND(F.lit(BLOCK_ROWS - 1))}), "ranges")
        self.tasks = max(1, -(-self.stored.count() // BLOCK_ROWS))
        self.rows = self.deal(self.stored)

    def deal(self, rows: DataFrame) -> DataFrame:
        """``rows`` dealt to tasks by block, as many tasks as the rows make full
        blocks: a number that is asked for is not coalesced."""
        return rows.repartition(self.tasks, "_pid")

    def running(self, rows: DataFrame, values: Mapping[str, Column | str], ops: Mapping[str, str] | None = None,
                exact: bool = False, by: list[str] | None = None) -> DataFrame:
        """Add the inclusive running sum (or min, max) of each value over the
        order. ``rows``: :attr:`rows`, perhaps with columns added by an earlier
        pass. A null adds nothing; sums start at 0, extremes at null. ``exact``:
        sum as 18-decimal fixed point, so the blocks' ends leave no trace. ``by``:
        sums restart per group of these columns, which the order begins with."""
        ops, by = dict(ops or {}), list(by or [])
        if by and any(op != "sum" for op in ops.values()):
            raise ValueError("per-group running aggregates support 'sum' only")
        for op in ops.values():
            if op not in _OPS:
                raise ValueError(f"unsupported running op {op!r}")
        exprs = {n: (F.col(v) if isinstance(v, str) else v).cast("double") for n, v in values.items()}
        exprs = {n: F.coalesce(e, F.lit(0.0)) if ops.get(n, "sum") == "sum" else e for n, e in exprs.items()}
        if exact:
            exprs = {n: e.cast(EXACT) if ops.get(n, "sum") == "sum" else e for n, e in exprs.items()}
        here = Window.partitionBy("_pid", *by).orderBy("_loc").rowsBetween(Window.unboundedPreceding, 0)
        plain = self.stored if rows is self.rows else rows
        if by:
            offsets = self._carried(plain, exprs, by)
        else:
            before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
            totals = plain.groupBy("_pid").agg(*[_OPS[ops.get(n, "sum")](e).alias(f"_t_{n}") for n, e in exprs.items()])
            offsets = totals.select("_pid", *[_OPS[ops.get(n, "sum")](f"_t_{n}").over(before).alias(f"_o_{n}") for n in exprs])
        offsets = offsets.withColumnsRenamed({b: f"_b_{b}" for b in by}).withColumnRenamed("_pid", "_opid")
        out = rows.withColumns({n: _OPS[ops.get(n, "sum")](e).over(here) for n, e in exprs.items()})
        same = [F.col("_pid") == F.col("_opid"), *[out[b].eqNullSafe(offsets[f"_b_{b}"]) for b in by]]
        out = out.join(F.broadcast(offsets), same, "left").drop("_opid", *[f"_b_{b}" for b in by])  # one row per block
        for n in exprs:
            op, off = ops.get(n, "sum"), F.col(f"_o_{n}")
            join = {"sum": F.col(n) + F.coalesce(off, F.lit(0.0)), "min": F.least(n, off), "max": F.greatest(n, off)}[op]
            out = out.withColumn(n, join.cast("double"))
        return out.drop(*[f"_o_{n}" for n in exprs])

    @staticmethod
    def _carried(plain: DataFrame, exprs: Mapping[str, Column], by: list[str]) -> DataFrame:
        """One row per block: its first group, and the group's sums over the blocks
        before. Groups follow each other in the order, so only a block's last group
        goes on in the next; the others are never shuffled."""
        firsts = plain.where("_loc = 0").select("_pid", *by, F.lit(True).alias("_first"), *[F.lit(None).alias(f"_t_{n}") for n in exprs])
        ends = plain.groupBy("_pid").agg(F.max("_loc").alias("_loc")).withColumnsRenamed({"_pid": "_opid", "_loc": "_oloc"})
        lasts = plain.join(F.broadcast(ends), (F.col("_pid") == F.col("_opid")) & (F.col("_loc") == F.col("_oloc")))
        lasts = lasts.select(F.col("_pid").alias("_opid"), *[F.col(b).alias(f"_b_{b}") for b in by])
        tails = plain.withColumns({f"_t_{n}": e for n, e in exprs.items()}).join(
            F.broadcast(lasts), [F.col("_pid") == F.col("_opid"), *[F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by]], "left_semi")
        tails = tails.groupBy("_pid", *by).agg(F.lit(False).alias("_first"), *[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in exprs])
        before = Window.partitionBy(*by).orderBy("_pid").rangeBetween(Window.unboundedPreceding, -1)
        return (tails.unionByName(firsts).withColumns({f"_o_{n}": F.sum(f"_t_{n}").over(before) for n in exprs})
                .where("_first").select("_pid", *by, *[f"_o_{n}" for n in exprs]))

    @staticmethod
    def decayed(rows: DataFrame, values: Mapping[str, Column | str], alpha: float) -> DataFrame:
        """Add ``m_t = alpha * m_{t-1} + v_t`` for each value.

        The recurrence is an affine scan: each block computes its local decayed
        sums from zero (vectorised), the blocks' lengths and last values give the
        carry into each block by ``C_{p+1} = alpha^len_p * C_p + L_p``, and
        ``m_t = alpha^k * C_p + L_t`` for the k-th row of a block. Python holds one
        block at a time. A later pass needs the rows dealt anew (:meth:`deal`)."""
        spark = rows.sparkSession
        names = list(values)
        prep = rows.withColumns({f"_v_{n}": (F.col(v) if isinstance(v, str) else v).cast("double") for n, v in values.items()})
        schema = T.StructType([*prep.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

        def scan(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_loc")
            for n in names:
                pdf[n] = decayed_sums(np.nan_to_num(pdf[f"_v_{n}"].to_numpy(dtype="float64")), alpha)
            return pdf

        local = prep.groupBy("_pid").applyInPandas(scan, schema).drop(*[f"_v_{n}" for n in names])
        last = local.groupBy("_pid").agg((F.max("_loc") + 1).alias("_len"), *[F.max_by(n, "_loc").alias(n) for n in names])
        carries, c = [], dict.fromkeys(names, 0.0)
        for r in sorted(last.collect()):  # one row per block
            carries.append((r["_pid"], *[c[n] for n in names]))
            c = {n: alpha ** r["_len"] * c[n] + r[n] for n in names}
        table = spark.createDataFrame(carries, T.StructType(
            [T.StructField("_pid", T.LongType()), *[T.StructField(f"_c_{n}", T.DoubleType()) for n in names]]))
        out = local.join(F.broadcast(table), "_pid", "left")
        k = (F.col("_loc") + 1).cast("double")
        return out.withColumns({n: F.col(n) + F.pow(F.lit(alpha), k) * F.col(f"_c_{n}") for n in names}).drop(
            *[f"_c_{n}" for n in names])


def decayed_sums(v: np.ndarray, alpha: float, start: float = 0.0) -> np.ndarray:
    """L_k = alpha * L_{k-1} + v_k from L_0 = ``start``, in blocks short enough that
    alpha^-k stays far from overflow."""
    if alpha == 1.0:
        return np.cumsum(np.r_[start, v])[1:]
    out = np.empty(len(v))
    step = max(1, int(50.0 / -np.log(alpha)))
    prev = start
    for s in range(0, len(v), step):
        blk = v[s:s + step]
        k = np.arange(1, len(blk) + 1, dtype="float64")
        out[s:s + len(blk)] = alpha ** k * (prev + np.cumsum(blk * alpha ** (-k)))
        prev = out[s + len(blk) - 1]
    return out


def running(df: DataFrame, order: list, values: Mapping[str, Column | str], ops: Mapping[str, str] | None = None,
            partitions: int | None = None, by: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Add one column per entry of ``values``: the inclusive running
    ``sum``/``min``/``max`` of that expression over the global ``order``.

    ``order`` must be a total order (add a unique id as last key). Sums are
    doubles: exact for whole numbers below 2^53; for others the last bits may
    depend on where the blocks end.

    ``by``: restart the running sums per group. Rows are ranged over (by,
    order) together, so a hot group spans many tasks; what a group has in the
    blocks before is carried into each block that begins with it."""
    r = Ranges(df, [*(by or []), *order], partitions)
    return r.running(r.rows, values, ops, exact, by).drop("_pid", "_loc")


def global_rank(df: DataFrame, order: list, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based position of each row in a total ``order`` (a distributed
    ``row_number()`` without a single-partition window): place in the block plus
    the counts of the blocks before."""
    rows = Ranges(df, order, partitions).stored
    counts = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    return (rows.join(F.broadcast(offsets), "_pid", "left")
            .withColumn(name, (F.col("_off") + F.col("_loc") + 1).cast("long")).drop("_pid", "_loc", "_off"))


def decayed_running(df: DataFrame, order: list, values: Mapping[str, Column | str], alpha: float,
                    partitions: int | None = None) -> DataFrame:
    """Running sums with a forgetting factor over a global order (see
    :meth:`Ranges.decayed`)."""
    r = Ranges(df, order, partitions)
    return r.decayed(r.rows, values, alpha).drop("_pid", "_loc")
