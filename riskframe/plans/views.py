"""Views over the driver tables that stand in for card transactions.

* ``tx``      events + customer + nation + region -> one transaction per event
* ``scored``  ``tx`` plus a deterministic stand-in probability
* ``ml``      embeddings -> one V feature per dimension and a binary label
* ``tx_big``  lineitem + orders, for scale runs of order-free aggregates
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import schema as S


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation + region: 25 x 5 rows by the TPC-H definition, a fixed size,
    so broadcasting region into nation is safe at any scale factor."""
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region", "r_regionkey", "r_name")
    return (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left")
            .select("n_nationkey", "r_name"))


def customer_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer + geography, one row per ``c_custkey``.

    The aggregate by the primary key is a no-op on the data but tells
    Catalyst the key is unique, so a left join to this dimension is removed
    from every plan that reads no dimension column (most of them): only the
    fact table is scanned. Where the columns are used, the aggregate's hash
    partitioning on the key is reused by the join."""
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    geo = geography(spark, sf_dir)
    j = cust.join(F.broadcast(geo), cust.c_nationkey == geo.n_nationkey, "left")
    return j.groupBy("c_custkey").agg(F.max("c_mktsegment").alias("c_mktsegment"), F.max("r_name").alias("r_name"))


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per event.

    ``Time`` is seconds since the first event (a scalar subquery, no cross
    join). The customer join is left and not hinted: AQE broadcasts the
    customer side when its runtime size is small and keeps a sort-merge join
    with skew splitting otherwise; the geography side (25 rows) is
    broadcast into the customer side.
    """
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    cust_geo = customer_dimension(spark, sf_dir)
    t0 = ev.agg(F.min("ts")).scalar()
    merchant = F.get_json_object(F.col("props"), "$.k").cast("long")
    channel = F.element_at(F.array(*[F.lit(c) for c in S.CHANNELS]),
                           (F.pmod(merchant, F.lit(4)) + 1).cast("int"))
    j = ev.join(cust_geo, ev.user_id == cust_geo.c_custkey, "left")
    return j.select(
        F.col("event_id").alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.timestamp_diff("MICROSECOND", t0, F.col("ts")) / 1e6).alias("Time"),
        F.col("value").alias("Amount"),
        F.col("user_id").alias("customer_id"),
        merchant.alias("merchant_id"),
        F.col("event_type").alias("transaction_type"),
        F.col("c_mktsegment").alias("card_type"),
        F.col("r_name").alias("region"),
        channel.alias("channel"),
        ((F.col("event_type") == "error") & (F.col("value") >= 75)).cast("int").alias("Class"),
    )


def stand_in_probability(amount="Amount"):
    """Deterministic stand-in for a model score: ``round(1-exp(-Amount/50), 6)``."""
    a = F.col(amount) if isinstance(amount, str) else amount
    return F.round(F.lit(1.0) - F.exp(-a / 50.0), 6)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx(spark, sf_dir).withColumn("fraud_probability", stand_in_probability())


def ml_columns(spark: SparkSession, sf_dir: str) -> list[str]:
    """V1..Vd for the embeddings' own width d."""
    d = table(spark, sf_dir, "embeddings", "embedding").agg(F.max(F.size("embedding"))).first()[0] or 0
    return [f"V{i}" for i in range(1, d + 1)]


def ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dimension of the embeddings as a feature, and a binary label."""
    emb = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    cols = [F.col("vec_id").alias("transaction_id")]
    cols += [F.get("embedding", F.lit(i)).cast("double").alias(v) for i, v in enumerate(ml_columns(spark, sf_dir))]
    cols += [(F.col("label") == 0).cast("int").alias("Class")]
    return emb.select(*cols)


def tx_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem + orders. Both sides grow with the scale factor, so this is a
    shuffle join on the order key (bucket both tables by it in production to
    drop the exchange)."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice",
               "l_discount", "l_returnflag")
    od = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    return j.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_suppkey").alias("merchant_id"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("Amount"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        (F.col("l_returnflag") == "R").cast("int").alias("Class"),
    )
