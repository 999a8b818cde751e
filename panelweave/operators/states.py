"""Group statistics kept as mergeable states, so that a new period costs a period.

A state is one row for each group and batch: per column the number of known values, their sum and the sum of their squares. States
are added up on read. Only periods that no batch has covered yet are computed; a correction is a batch of its own, of what it
takes away and what it puts in place, and costs the rows it touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import finite
from ..sources.ledgers import append_rows, pending
from ..sources.tables import table_exists, write_table


def partial_state(rows: DataFrame, by: list[str], columns: list[str], sign: int = 1) -> DataFrame:
    """One row for each group: n, sum and square sum of each column, negative with ``sign`` -1. Sums combine on the map side."""
    x = {c: finite(c) for c in columns}
    return rows.groupBy(*by).agg(
        *[
            (sign * e).alias(f"{c}_{kind}")
            for c in columns
            for kind, e in (("n", F.count(x[c])), ("sum", F.coalesce(F.sum(x[c]), F.lit(0.0))), ("sq", F.coalesce(F.sum(x[c] * x[c]), F.lit(0.0))))
        ]
    )


def update(rows: DataFrame, path: str, by: list[str], columns: list[str], period: str = "date") -> DataFrame:
    """Adds the states of the periods of ``rows`` that ``path`` does not hold yet, and returns those periods.

    Nothing else of ``rows`` is aggregated; run again, it adds nothing. A stopped run leaves no half batch, since a batch
    appears when its write commits."""
    spark = rows.sparkSession
    periods = rows.select(period).distinct()
    new = pending(periods, spark.read.parquet(path), period) if table_exists(spark, path) else periods
    new = spark.createDataFrame(new.collect(), periods.schema)  # a calendar
    if not new.isEmpty():
        append_rows(partial_state(rows.join(F.broadcast(new), period, "left_semi"), by, columns), path)
    return new


def correct(old: DataFrame, new: DataFrame, path: str, by: list[str], columns: list[str]) -> None:
    """Takes the rows ``old`` out of the states and puts ``new`` in their place."""
    append_rows(partial_state(old, by, columns, -1).unionByName(partial_state(new, by, columns)), path)


def merged(spark: SparkSession, path: str, by: list[str], columns: list[str]) -> DataFrame:
    """(by, <c>_n, <c>_mean, <c>_std) of every group over all batches; groups of which nothing is left do not appear."""
    state = spark.read.parquet(path)
    total = state.groupBy(*by).agg(*[F.sum(c).alias(c) for c in state.columns if c not in by])
    some = reduce(lambda a, b: a | b, [F.col(f"{c}_n") > 0 for c in columns])
    out = []
    for c in columns:
        n, s, q = (F.col(f"{c}_{k}") for k in ("n", "sum", "sq"))
        spread = F.sqrt(F.greatest(F.try_divide(q - F.try_divide(s * s, n), n - 1), F.lit(0.0)))
        out += [n.alias(f"{c}_n"), F.try_divide(s, n).alias(f"{c}_mean"), F.when(n > 1, spread).alias(f"{c}_std")]
    return total.filter(some).select(*by, *out)


def compacted(spark: SparkSession, path: str, into: str, by: list[str]) -> None:
    """Writes the states of ``path`` added up, one row a group, to ``into``; groups of which nothing is left stay as zeros, so
    that their periods count as done."""
    state = spark.read.parquet(path)
    write_table(state.groupBy(*by).agg(*[F.sum(c).alias(c) for c in state.columns if c not in by]), into)
