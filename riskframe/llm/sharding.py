"""Operator 1: sharding by best-fit-decreasing bin packing.

Rows with equal texts are one indivisible group. Groups, largest first, go
into the bin with the tightest room that still takes them, found in a balanced
search tree of the bins' remaining capacities.

All groups can't pass through one task, so the packing has two levels. Groups
are dealt by hash into slices, and each slice is packed into cartons, bins of a
small fraction of a shard. Their number depends on the number of shards and
slices, not on the corpus; they are packed into the shards by the same method.
With a given number of shards the capacity is the smallest (by bisection) for
which best-fit-decreasing needs no more shards, after groups larger than an
even share have got a shard of their own; so sizes come out near equal. With a
given capacity, as few shards as the method finds are used; a group larger than
that gets a shard of its own.

Size is UTF-8 bytes plus ROW_BYTES for each row; a null text has no bytes, its
checksum is 0, and null texts are one group. Ties go by the group's hash. Null
and repeated ids are kept as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import parts_for
from riskframe.session import materialize

ROW_BYTES = 16
#: cartons to a shard at the coarsest, and how many finer sizes the slices take in turn
CARTONS, FINER = 48, 4
#: groups that one slice packs
SLICE_GROUPS = 100_000
#: entries of a tree leaf before it splits
LEAF = 64


class RoomTree:
    """Balanced tree of (room, bin): a B+ tree of two levels, whose leaves
    split when full and leave when empty. ``take`` finds the tightest room."""

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = []
        self.highest: list[tuple[int, int]] = []

    def add(self, room: int, bin_: int) -> None:
        entry = (room, bin_)
        if not self.leaves:
            self.leaves, self.highest = [[entry]], [entry]
            return
        i = min(bisect_left(self.highest, entry), len(self.leaves) - 1)
        leaf = self.leaves[i]
        insort(leaf, entry)
        if len(leaf) > LEAF:
            half = len(leaf) // 2
            self.leaves[i:i + 1] = [leaf[:half], leaf[half:]]
            self.highest[i:i + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self.highest[i] = leaf[-1]

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the entry with the least room of at least ``size``."""
        i = bisect_left(self.highest, (size, -1))
        if i == len(self.leaves):
            return None
        leaf = self.leaves[i]
        entry = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.highest[i] = leaf[-1]
        else:
            del self.leaves[i], self.highest[i]
        return entry


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size; ``sizes`` descend. One larger than the capacity gets a bin of its own."""
    tree, out, bins = RoomTree(), [], 0
    for size in sizes:
        if size > capacity:
            out.append(bins)
            bins += 1
            continue
        entry = tree.take(size)
        if entry is None:
            entry = (capacity, bins)
            bins += 1
        room, b = entry
        tree.add(room - size, b)
        out.append(b)
    return out


def into_shards(sizes: list[int], n_shards: int) -> list[int]:
    """Shard of each size (descending), with near-equal sums."""
    total, out, rest = sum(sizes), [], n_shards
    for size in sizes:  # those above an even share of what is left stand alone
        if rest <= 1 or size * rest < total:
            break
        out.append(n_shards - rest)
        total, rest = total - size, rest - 1
    body = sizes[len(out):]
    if not body:
        return out
    low, high = max(body[0], -(-total // rest)), max(body[0], 2 * -(-total // rest))
    while max(best_fit_decreasing(body, high)) >= rest:
        high *= 2
    while low < high:
        mid = (low + high) // 2
        if max(best_fit_decreasing(body, mid)) < rest:
            high = mid
        else:
            low = mid + 1
    return out + [n_shards - rest + b for b in best_fit_decreasing(body, high)]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, grp): ``grp`` is the text's hash. Two texts
    with one hash share a shard, which does no harm."""
    raw = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
                       F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
                       F.xxhash64(text_col).alias("grp"))


def assign_groups(groups: DataFrame, n_shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """(grp, shard) for groups (grp, bytes): into ``n_shards`` near-equal
    shards, or into few of ``capacity`` bytes."""
    spark = groups.sparkSession
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], "grp long, shard int")
    share = capacity or max(1, total // n_shards)
    slices = parts_for(n, SLICE_GROUPS) * 64

    def cartons(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "grp"], ascending=[False, True])
        small = max(1, share // (CARTONS << (int(key[0]) % FINER)))
        b = best_fit_decreasing(pdf["bytes"].tolist(), small)
        return pd.DataFrame({"slice": pdf["slice"], "carton": b, "grp": pdf["grp"], "bytes": pdf["bytes"]})

    sliced = groups.withColumn("slice", F.pmod(F.xxhash64("grp", F.lit("slice")), F.lit(slices)))
    packed, _ = materialize(sliced.groupBy("slice").applyInPandas(cartons, "slice long, carton int, grp long, bytes long"),
                            "shard-cartons")
    # at most 2 * shards * CARTONS * 2**FINER + slices of them, whatever the corpus holds
    table = packed.groupBy("slice", "carton").agg(F.sum("bytes").alias("bytes")).toPandas()
    table = table.sort_values(["bytes", "slice", "carton"], ascending=[False, True, True])
    sizes = table["bytes"].tolist()
    table["shard"] = into_shards(sizes, n_shards) if n_shards else best_fit_decreasing(sizes, capacity)
    where = spark.createDataFrame(table[["slice", "carton", "shard"]].astype(
        {"slice": "int64", "carton": "int32", "shard": "int32"}), "slice long, carton int, shard int")
    return packed.join(F.broadcast(where), ["slice", "carton"]).select("grp", "shard")


def shard_rows(docs: DataFrame, n_shards: int | None = None, capacity: int | None = None,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, grp, shard, slot): every row's shard and its
    place there, gapless from 0. Give ``n_shards`` or ``capacity``."""
    if (n_shards is None) == (capacity is None):
        raise ValueError("give n_shards or capacity")
    rows = measured(docs, id_col, text_col)
    groups, _ = materialize(rows.groupBy("grp").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed, _ = materialize(rows.join(assign_groups(groups, n_shards, capacity), "grp"), "shard-rows")
    # slots: rank within (shard, part) plus the counts of the parts before; a shard's rows are spread over the parts
    parts = parts_for(placed.count(), 100_000) * 8
    part = F.pmod(F.xxhash64("doc_id", "grp", F.monotonically_increasing_id()), F.lit(parts))
    placed, _ = materialize(placed.withColumn("part", part), "shard-parts")
    counts = placed.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "grp"))
    ranked = placed.withColumn("rank", rank)
    return ranked.join(counts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "grp", "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"))
