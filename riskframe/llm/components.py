"""Connected components by repeated contraction, in joins and aggregations.

Each round points every node at its smallest neighbour (by a hash that changes
with the round, so that adverse numberings don't matter), follows the pointers
twice, and rewrites the edges between the nodes pointed at. The node count
falls by a constant factor a round. Nothing is gathered per node: the
aggregations combine map-side and the joins have one row per node on one side,
so the adaptive skew join splits a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.session import drop_path, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst",
                         max_rounds: int = 100) -> DataFrame:
    """One row (node, root) for each node that occurs in ``edges``: all nodes
    of a component have the same root, one of its nodes. Null ends and loops
    are ignored; an empty table gives an empty result."""
    spark = edges.sparkSession
    e = (edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"))
         .where("u is not null and v is not null and u <> v"))
    e, path = materialize(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-e")
    maps: list[DataFrame] = []
    for r in range(max_rounds):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

        def rank(c):
            return F.struct(F.xxhash64(F.col(c), F.lit(r)).alias("h"), F.col(c).alias("id"))

        near = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        ptr = near.select(F.col("u").alias("node"), F.least(rank("u"), F.col("m"))["id"].alias("to"))
        ptr, p0 = materialize(ptr, "cc-p")
        for _ in range(2):
            nxt = ptr.select(F.col("node").alias("to"), F.col("to").alias("to2"))
            ptr = ptr.join(nxt, "to").select("node", F.col("to2").alias("to"))
        ptr, p1 = materialize(ptr, "cc-j")
        maps.append(ptr)
        pu = ptr.select(F.col("node").alias("u"), F.col("to").alias("ru"))
        pv = ptr.select(F.col("node").alias("v"), F.col("to").alias("rv"))
        nxt = (e.join(pu, "u").join(pv, "v").where("ru <> rv")
               .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
        e, new = materialize(nxt, "cc-e")
        drop_path(spark, path)
        drop_path(spark, p0)
        path = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    drop_path(spark, path)
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    out = maps[0].select("node", F.col("to").alias("root"))
    for m in maps[1:]:
        step = m.select(F.col("node").alias("root"), F.col("to").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
