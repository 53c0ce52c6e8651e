"""Register of runnable queries and, where SQL can say it, their DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` must give the same columns and values."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: comparable(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def six_decimals(c: Column) -> Column:
    """Rounded in binary, half away from zero, as DuckDB does it.

    Spark's own `round` works on the shortest decimal text and differs where a
    value was rounded to more places before.
    """
    return F.signum(c) * F.floor(F.abs(c) * 1e6 + 0.5) / 1e6


def comparable(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, fractions as doubles with six decimals."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("bigint") if f.dataType.scale == 0 else six_decimals(c.cast("double"))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = six_decimals(c.cast("double"))
        cols.append(c.alias(f.name))
    return df.select(*cols)
