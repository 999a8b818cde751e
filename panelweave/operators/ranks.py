"""Exact ranks inside groups of any size.

A full rank of one date's cross-section would put that whole date into one task. Rows are therefore dealt by ranges of group
and order key: a group lies in one range or in several that follow each other. Each range is ranked by itself, and shifted by
the rows of its group in the ranges before it, of which there is one line a range. Groups of one row and groups that
hold most of the table go the same way; ranges are of even size, however the groups are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.staging import stage

TASK_ROWS = 2_000_000  # of a range, about
SMALL_RANGES = 40  # more of them only where ranges would hold more than TASK_ROWS: up to 128, Spark looks for a row's range from the first on


def range_count(n: int, task_rows: int, cores: int) -> int:
    """Ranges that n rows are cut into: of ``task_rows`` where that takes no more than ``SMALL_RANGES`` tasks; a task for every few
    rows costs more than the rows."""
    asked = min(-(-n // task_rows), max(SMALL_RANGES, -(-n // TASK_ROWS)))
    return max(cores, asked)


def rank_within(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    rank: str = "rank",
    size: str | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Position 1..n of each row in its group, ascending by ``order`` (end it with a unique key).

    For a descending number pass its negative. ``size`` names an optional column with the group's row count."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    rows = stage(df, "rank-input")
    parts = range_count(rows.count(), task_rows, rows.sparkSession.sparkContext.defaultParallelism)
    ranged = rows.withColumn("_key", key).repartitionByRange(parts, *by, "_key").sortWithinPartitions(*by, "_key").drop("_key")
    # sorted rows are numbered as they lie: the rows are sent once, and a group's place in a range follows from its first number
    ranged = stage(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "rank-ranges")
    counts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    group = Window.partitionBy(*by)  # one line for each range that the group reaches into
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
        F.col("_range").alias("_at"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        *([F.sum("_n").over(group).alias(size)] if size else []),
    )
    shift = stage(shift, "rank-shift")  # its size decides whether the ranges have to be sent again
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return ranged.join(shift, same).withColumn(rank, (F.col("_place") + F.col("_shift")).cast("bigint")).select(
        *df.columns, *([size] if size else []), rank
    )


def score_rank(scores: DataFrame, score: str = "ranker_score", rank: str = "rank_by_date", **kw) -> DataFrame:
    """Rank by descending score inside each date; equal scores go by ticker, rows without a score (null or NaN) last."""
    value = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    return rank_within(scores, ["date"], [value.isNull(), -value, F.col("ticker")], rank, **kw)


def top_n(df: DataFrame, n: int | Column, by: list[str], order: list[Column], rank: str = "rank_by_date") -> DataFrame:
    """The first n rows of each group. The filter on row_number lets Spark drop the rest before the shuffle, so
    a task receives at most n rows per group and map task."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(w).cast("bigint"))
    return out.filter(F.col(rank) <= n)


def fifths(df: DataFrame, value: str = "future_1m_return", label: str = "ranking_label", **kw) -> DataFrame:
    """Label 0..4 by the fifth that the value's rank share falls into (cuts at 0.2 steps, right-closed).

    Rows without a value have no label. Differs from ntile(5) when n is not a multiple of five."""
    known = df.filter(F.col(value).isNotNull())
    ranked = rank_within(known, ["date"], [F.col(value), F.col("ticker")], "_rank", "_size", **kw)
    share = F.col("_rank") / F.col("_size")
    cut = F.lit(4)
    for i, edge in reversed(list(enumerate((0.2, 0.4, 0.6, 0.8)))):
        cut = F.when(share <= edge, F.lit(i)).otherwise(cut)
    return ranked.withColumn(label, cut).drop("_rank", "_size")
