"""Every registered query against its DuckDB oracle (or, without one, that
it runs and yields rows)."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

NAMES = sorted(E.queries())
SQL = E.oracle_sql()
# rows-only queries whose output can legitimately be empty on a tiny table
MAY_BE_EMPTY = set()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    r = compare(spark, name, sf_dir, con)
    if name in SQL:
        assert r["status"] == "match", r
    else:
        assert r["spark_rows"] > 0 or name in MAY_BE_EMPTY, r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 1
    assert [f.name for f in df.schema.fields] == ["batch_id", "total_transactions", "high_risk_count",
                                                  "medium_risk_count", "low_risk_count", "fraud_rate"]


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())
