"""Run a registered Spark query and its DuckDB oracle side by side and
compare row count, column names/types and order-insensitive values.

Usage: python -m tests.oracle_check [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_SPARK_FAMILY = {"IntegerType": "int32", "LongType": "int64", "DoubleType": "float64",
                 "FloatType": "float32", "StringType": "string", "BooleanType": "bool",
                 "ShortType": "int16", "ByteType": "int8", "DateType": "date"}
_DUCK_FAMILY = {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "float64", "FLOAT": "float32",
                "VARCHAR": "string", "BOOLEAN": "bool", "SMALLINT": "int16", "TINYINT": "int8",
                "DATE": "date"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = v if os.environ.get("ORACLE_STRICT") else round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    t0 = time.time()
    sdf = qs[name](spark, sf_dir)
    s_cols = sdf.columns
    s_types = {f.name: _SPARK_FAMILY.get(type(f.dataType).__name__, type(f.dataType).__name__)
               for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    out = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if name not in sqls:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    rel = con.sql(sqls[name])
    d_cols = rel.columns
    d_types = {c: _DUCK_FAMILY.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    out["sql_rows"] = len(d_rows)
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_cols)} sql={sorted(d_cols)}")
    else:
        bad = {c: (s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]}
        if bad:
            problems.append(f"types {bad}")
        order = sorted(s_cols)
        si = [s_cols.index(c) for c in order]
        di = [d_cols.index(c) for c in order]
        sn = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=_key)
        dn = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=_key)
        if len(sn) != len(dn):
            problems.append(f"rows spark={len(sn)} sql={len(dn)}")
        elif sn != dn:
            diffs = [(a, b) for a, b in zip(sn, dn) if a != b]
            problems.append(f"values differ in {len(diffs)} rows, e.g. spark={diffs[0][0]} sql={diffs[0][1]}")
    out["status"] = "match" if not problems else "MISMATCH"
    if problems:
        out["problems"] = problems
    return out


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    sys.path.insert(0, ".")
    from riskframe.session import get_session
    import __spark_entry__ as E

    spark = get_session("local[8]", shuffle_partitions=8)
    names = a.names or sorted(E.queries())
    con = duck(a.sf)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, a.sf, con)
        except Exception as ex:  # report and continue
            r = {"name": n, "status": "ERROR", "problems": [repr(ex)[:400]]}
        bad += r["status"] in ("MISMATCH", "ERROR")
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main())
