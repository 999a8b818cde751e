"""Named queries and the SQL that must give the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, ShortType

DIGITS = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# prices come from integer sums, so both engines hold the very same double: rounding could only part them
EXACT = frozenset("price close high low volume value bench_price latest_price start_price end_price last_price".split())


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Computed doubles rounded (adding 0.0 removes the sign of zero), whole numbers as BIGINT."""

    def col(f):
        c = F.col(f"`{f.name}`")
        if f.name in EXACT:
            return c
        if isinstance(f.dataType, (DoubleType, FloatType)):
            return (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (IntegerType, ShortType, LongType)):
            return c.cast("bigint").alias(f.name)
        return c

    return df.select(*[col(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    """Register a query. ``doubles`` lists the SQL result columns to round as ``tidy`` does."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir), digits)
        if sql:
            fixes = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split() if c not in EXACT)
            ORACLES[name] = f"SELECT * REPLACE ({fixes}) FROM (\n{sql}\n)" if fixes else sql
        return fn

    return register
