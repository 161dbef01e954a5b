"""Registered queries: name -> f(spark, sf_dir), and DuckDB SQL with the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query and, if SQL can express it, its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add
