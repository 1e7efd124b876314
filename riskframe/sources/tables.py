"""Batch sources (S1-S3): typed scans of transaction tables and tables of
scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskframe import schema as S


def read_transactions(spark: SparkSession, path: str, fmt: str | None = None,
                      schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    """Scan a CSV (explicit schema, header, FAILFAST so a malformed file
    fails loudly instead of yielding nulls) or a parquet/json/orc table.
    Parquet keeps its own schema; CSV/JSON default to the raw transaction
    schema."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt == "csv":
        return (spark.read.schema(schema or S.raw_transaction_schema())
                .option("header", header).option("mode", "FAILFAST").csv(path))
    if fmt == "json":
        return spark.read.schema(schema or S.raw_transaction_schema()).option("mode", "FAILFAST").json(path)
    if fmt in ("parquet", "orc"):
        r = spark.read.schema(schema) if schema else spark.read
        return r.format(fmt).load(path)
    raise ValueError(f"unsupported format {fmt!r}")


def read_scored(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """A stored table of scored rows; ``None`` when it is missing or
    empty (``isEmpty`` reads at most one row). Any other failure is raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    df = spark.read.format(fmt).load(path)
    return None if df.isEmpty() else df


def from_records(spark: SparkSession, records: list[dict], schema: T.StructType | None = None) -> DataFrame:
    """S3: a table from in-memory records (request-sized input only; bulk
    data comes in through a scan)."""
    schema = schema or S.enriched_transaction_schema()
    rows = [tuple(r.get(f.name) for f in schema.fields) for r in records]
    return spark.createDataFrame(rows, schema)
