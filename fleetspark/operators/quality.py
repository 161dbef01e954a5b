"""Gates: checks on tables that raise, with what they found, before bad rows go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A table doesn't hold what it must."""


def no_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = {c: n for c, n in df.agg(*(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns)).first().asDict().items() if n}
    if bad:
        raise GateError(f"nulls: {bad}")
    return df


def same_rows(df: DataFrame, request: DataFrame, key: str) -> DataFrame:
    """One row for each request and no other."""
    a = df.select(F.col(key), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(request.select(F.col(key), F.lit(0), F.lit(1)))
    n = a.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a <> b").count()
    if n:
        raise GateError(f"{n} keys differ from the request")
    return df


def rate_at_least(df: DataFrame, hit: str, least: float) -> DataFrame:
    rate = df.agg(F.avg(F.col(hit).cast("int"))).first()[0] or 0.0
    if rate < least:
        raise GateError(f"share of {hit} is {rate:.3f}, under {least}")
    return df


def rows_at_least(df: DataFrame, least: int) -> DataFrame:
    if df.limit(least).count() < least:
        raise GateError(f"fewer than {least} rows")
    return df


def has_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise GateError(f"missing columns: {missing}")
    return df


def no_leaks(features: list[str], forbidden: list[str]) -> list[str]:
    bad = [f for f in features if any(w in f.lower() for w in forbidden)]
    if bad:
        raise GateError(f"leaked columns: {bad}")
    return features


def same_family(a: str, b: str) -> None:
    """Tables keyed by different families of operational days mustn't be joined."""
    if a != b:
        raise GateError(f"days of families {a} and {b}")
