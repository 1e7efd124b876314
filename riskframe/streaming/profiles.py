"""Live profile tables (T5, J3): per-key aggregates folded once per epoch.

A profile row is mergeable state: rows, known values and their exact sum,
labelled rows and positives. A :class:`ProfileStore` keeps one row a key in a
bucketed base table, and the keys touched since in a small recent table; each
epoch adds its own aggregate to the recent table, and when that has grown to a
fraction of the base the two are merged into a new base. Looking profiles up is
two left joins on the key: no aggregate over history, and no exchange of the base
(it is stored in buckets of the key). An epoch becomes visible by its manifest
(``epochs.EpochLog``), so a retried or crashed epoch neither counts twice nor
shows half.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions import scalars as X
from riskframe.streaming.epochs import EpochLog

_SUMS = ("rows", "known", "total", "labelled", "positives")


class ProfileStore:
    """Profiles by ``key`` under ``path`` (shared storage)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "customer_id", value: str = "Amount", label: str = "Class",
                 buckets: int | None = None, merge_at: float = 0.1):
        self.spark, self.path, self.key, self.value, self.label = spark, path.rstrip("/"), key, value, label
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.merge_at = merge_at
        self.log = EpochLog(spark, self.path)

    # ---- folding ----

    def delta(self, rows: DataFrame) -> DataFrame:
        """The mergeable aggregate of some rows (combined map-side)."""
        y = F.col(self.label).cast("long")
        return rows.groupBy(F.col(self.key).alias("_k")).agg(
            F.count(F.lit(1)).alias("rows"), F.count(X.finite(self.value)).alias("known"),
            F.coalesce(F.sum(X.finite(self.value).cast(X.EXACT)), F.lit(0).cast(X.EXACT)).alias("total"),
            F.count(y).alias("labelled"), F.coalesce(F.sum(y), F.lit(0)).alias("positives"))

    @staticmethod
    def _merge(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out.groupBy("_k").agg(*[F.sum(c).cast(X.EXACT if c == "total" else "long").alias(c) for c in _SUMS])

    def fold(self, rows: DataFrame, epoch: int) -> None:
        """Add one epoch's rows; an epoch that is committed already adds nothing."""
        newest, state = self.log.newest()
        if epoch <= newest:
            return
        recent = self._recent(state)
        added = self._merge([self.delta(rows), *([recent] if recent is not None else [])])
        out = self.log.folder("recent", epoch)
        added.write.mode("overwrite").parquet(out)
        n = self.spark.read.parquet(out).count()
        state = {"base": state.get("base"), "base_rows": state.get("base_rows", 0), "recent": epoch}
        if n > self.merge_at * state["base_rows"]:
            whole = self._merge([self.spark.read.parquet(out), *([self._base(state)] if state["base"] is not None else [])])
            self._write_base(whole, epoch)
            state = {"base": epoch, "base_rows": self._base({"base": epoch}).count(), "recent": None}
        self.log.commit(epoch, state)

    # ---- the base table: external, bucketed by the key ----

    def _table(self, version: int) -> str:
        return f"riskframe_profile_{hashlib.md5(self.path.encode()).hexdigest()[:12]}_{version}"

    def _write_base(self, df: DataFrame, version: int) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(version)}")
        (df.repartition(self.buckets, "_k").write.mode("overwrite").bucketBy(self.buckets, "_k").sortBy("_k")
         .option("path", self.log.folder("base", version)).saveAsTable(self._table(version)))

    def _base(self, state: dict) -> DataFrame | None:
        if state.get("base") is None:
            return None
        name, path = self._table(state["base"]), self.log.folder("base", state["base"])
        if not self.spark.catalog.tableExists(name):  # another session wrote it: name its folder here
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
            self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (_k) SORTED BY (_k) "
                           f"INTO {state.get('buckets', self.buckets)} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _recent(self, state: dict) -> DataFrame | None:
        return None if state.get("recent") is None else self.spark.read.parquet(self.log.folder("recent", state["recent"]))

    # ---- reading ----

    def lookup(self, rows: DataFrame, prefix: str = "profile_") -> DataFrame:
        """``rows`` with the key's profile as of the newest committed epoch: the
        number of rows (0 for a new key), mean value and label rate (null without
        any)."""
        _, state = self.log.newest()
        parts = [p for p in (self._base(state), self._recent(state)) if p is not None]
        out = rows
        for i, p in enumerate(parts):
            p = p.select(F.col("_k").alias(f"_k{i}"), *[F.col(c).alias(f"_{c}{i}") for c in _SUMS])
            out = out.join(p, F.col(self.key) == F.col(f"_k{i}"), "left")

        def total(c):
            sums = [F.coalesce(F.col(f"_{c}{i}"), F.lit(0).cast(X.EXACT if c == "total" else "long")) for i in range(len(parts))]
            return sum(sums[1:], sums[0]) if sums else F.lit(0).cast("long")

        made = {f"{prefix}tx_count": total("rows").cast("long"),
                f"{prefix}avg_{self.value.lower()}": F.try_divide(total("total").cast("double"), total("known").cast("double")),
                f"{prefix}rate": F.try_divide(total("positives").cast("double"), total("labelled").cast("double"))}
        return out.select(*[F.col(c) for c in rows.columns], *[e.alias(n) for n, e in made.items()])


def enrich_and_fold(store: ProfileStore, base: str, columns: list[str]):
    """foreachBatch sink: each row with its key's profile over all earlier
    epochs (under ``base``), then the micro-batch joins the profiles."""
    def sink(b: DataFrame, epoch: int, _out: str) -> None:
        spark = b.sparkSession
        here = ProfileStore(spark, store.path, store.key, store.value, store.label, store.buckets, store.merge_at)
        newest, _ = here.log.newest()
        if epoch <= newest:
            return
        held = b.persist()
        try:
            made = here.lookup(held)
            made.select(*columns, *[c for c in made.columns if c not in held.columns]).write.mode("overwrite").parquet(
                f"{base}/_epoch={epoch}")
            here.fold(held, epoch)
        finally:
            held.unpersist()
    return sink
