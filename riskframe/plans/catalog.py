"""Registry of named queries (Spark side) and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from riskframe.session import ship_package

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")

        def run(spark, sf_dir):
            ship_package(spark)  # tasks import it by name
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from riskframe.plans import (queries_core, queries_misc, queries_ml, queries_profile,  # noqa: F401
                                 queries_report, queries_stream)
