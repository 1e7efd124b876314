"""JSON payloads to typed rows with defaults for optional fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe import schema as S


def parse_json(df: DataFrame, text_col: str, schema: T.StructType, keep: list[str] | None = None,
               corrupt_col: str = "_corrupt") -> DataFrame:
    """Parse one JSON document per row with ``from_json`` (PERMISSIVE): a
    document that does not parse gives null fields and is flagged in
    ``corrupt_col`` instead of failing the job; so does one with a field that
    doesn't fit its type. An object without some (or all) fields is not corrupt."""
    bad = "_corrupt_record_"
    full = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    parsed = F.from_json(F.col(text_col), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    keep = keep or []
    out = df.select(*keep, parsed.alias("_p"))
    return out.select(*keep, *[F.col("_p")[f.name].alias(f.name) for f in schema.fields],
                      F.coalesce(F.col("_p")[bad].isNotNull(), F.lit(False)).alias(corrupt_col))


def parse_transactions(df: DataFrame, text_col: str = "payload") -> DataFrame:
    """Request payloads (one transaction per document) with the enriched
    schema; categorical defaults filled."""
    from riskframe.operators.validate import fill_defaults

    return fill_defaults(parse_json(df, text_col, S.enriched_transaction_schema()))


def parse_batches(df: DataFrame, text_col: str = "payload") -> DataFrame:
    """Batch payloads ``{"transactions": [...]}``: parsed, then ``inline``d to
    one row per transaction (a generator, no driver round-trip)."""
    from riskframe.operators.validate import fill_defaults

    batch = T.StructType([T.StructField("transactions", T.ArrayType(S.enriched_transaction_schema()))])
    p = df.select(F.from_json(F.col(text_col), batch).alias("_b"))
    return fill_defaults(p.select(F.inline(F.coalesce(F.col("_b.transactions"),
                                                      F.array().cast(batch["transactions"].dataType)))))
