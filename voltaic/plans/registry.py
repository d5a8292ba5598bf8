"""Registry of named queries: Spark callable + optional DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def finish(df: DataFrame) -> DataFrame:
    """Round every double to ``DIGITS`` places (summation order differs between
    engines); the oracle text rounds the same columns."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_up(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def round_half_up(c, digits: int = DIGITS):
    """floor(x * 10^d + 0.5) / 10^d in plain IEEE arithmetic, so Spark and DuckDB
    agree bit for bit (Spark's ``round`` rounds the decimal string instead)."""
    scale = float(10 ** digits)
    return F.when(F.abs(c) < 1e12, F.floor(c * scale + 0.5) / scale).otherwise(c)


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


def r(expr: str, alias: str, digits: int = DIGITS) -> str:
    """Oracle helper: a rounded double column."""
    x = f"cast({expr} as double)"
    scale = f"{float(10 ** digits)!r}"
    return (f"(case when abs({x}) < 1e12 then floor({x} * {scale} + cast(0.5 as double)) / {scale} "
            f"else {x} end) as {alias}")
