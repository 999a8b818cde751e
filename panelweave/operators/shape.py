"""Panel shaping: period ends, returns, the dense grid, fills and as-of joins."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rolling import Rolling
from ..functions.scalars import month_end as month_end_of, ratio
from .ranks import rank_within


def month_end(df: DataFrame, key: str = "ticker", date: str = "date", value: str = "price") -> DataFrame:
    """Last non-null value of each calendar month, dated on the month's last day; empty months do not appear."""
    v = F.col(value)
    return (
        df.filter(v.isNotNull())
        .groupBy(key, month_end_of(date).alias("date"))
        .agg(F.max_by(v, F.col(date)).alias(value))
    )


def last_completed_month(as_of: dt.date | Column) -> Column:
    day = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.last_day(F.add_months(day, -1))


def completed_only(df: DataFrame, as_of: dt.date | Column, date: str = "date") -> DataFrame:
    """Drop the month that ``as_of`` lies in: an unfinished month is not a month."""
    return df.filter(F.col(date) <= last_completed_month(as_of))


def by_ticker(df: DataFrame) -> DataFrame:
    """Rows of a ticker together, in a given number of partitions. Adaptive execution would merge them by bytes, but
    rolling windows are bound by arithmetic: a few megabytes can be minutes of work for one core."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ticker")


def dense_grid(
    prices: DataFrame, tickers: DataFrame, dates: DataFrame, value: str | list[str] = "price"
) -> DataFrame:
    """Every ticker on every date, NULL where there is no price.

    The calendar (bounded by the number of dates) becomes one array inside the plan and is exploded per ticker.
    Skeleton and prices are then brought together by ticker alone, so the windows that follow need no second
    exchange. Prices outside the requested tickers are not part of the grid."""
    values = [value] if isinstance(value, str) else value
    calendar = dates.select(F.array_sort(F.collect_set("date"))).scalar()
    skeleton = tickers.select("ticker").distinct().select("ticker", F.explode(calendar).alias("date"))
    asked = skeleton.withColumn("_asked", F.lit(True))
    seen = prices.select("ticker", "date", *values)
    return (
        by_ticker(asked.unionByName(seen, allowMissingColumns=True))
        .groupBy("ticker", "date")
        .agg(*[F.max(v).alias(v) for v in values], F.max("_asked").alias("_asked"))
        .filter("_asked")
        .drop("_asked")
    )


def simple_returns(grid: DataFrame, value: str = "price", fill: str = "none") -> DataFrame:
    """One-row returns on a dense grid. ``fill="pad"`` carries the last price over gaps first."""
    t = Rolling()
    if fill == "pad":
        grid = grid.withColumn(value, t.fill(value))
    elif fill != "none":
        raise ValueError("fill is 'none' or 'pad'")
    return grid.withColumn("ret", t.ret(value))


def returns_long(grid: DataFrame, value: str = "price") -> DataFrame:
    return simple_returns(grid, value).select("date", "ticker", F.col("ret").alias("monthly_return")).filter(
        F.col("ret").isNotNull()
    )


def coverage(grid: DataFrame, requested: DataFrame, value: str = "price") -> DataFrame:
    """Per requested ticker: is it there at all, how many prices, first and last date, and is it up to date."""
    v = F.col(value)
    newest = grid.select(F.max("date")).scalar()
    have = grid.groupBy("ticker").agg(
        F.count_if(v.isNull()).alias("missing_count"),
        F.count(v).alias("non_missing_count"),
        F.min(F.when(v.isNotNull(), F.col("date"))).alias("first_date"),
        F.max(F.when(v.isNotNull(), F.col("date"))).alias("last_date"),
        F.max_by(v, F.when(v.isNotNull(), F.col("date"))).alias("latest_price"),
    )
    return (
        requested.select("ticker")
        .join(have.withColumn("present", F.lit(True)), "ticker", "left")
        .select(
            "ticker",
            F.coalesce("present", F.lit(False)).alias("present"),
            "missing_count",
            F.coalesce("non_missing_count", F.lit(0)).alias("non_missing_count"),
            "first_date",
            "last_date",
            "latest_price",
            F.coalesce(F.col("last_date") == newest, F.lit(False)).alias("has_latest_month"),
        )
    )


def bounded_fill(df: DataFrame, columns: list[str], limit: int = 7) -> DataFrame:
    """Carry values forward over at most ``limit`` missing rows."""
    t = Rolling()
    return df.select(*[t.fill(c, limit).alias(c) if c in columns else F.col(c) for c in df.columns])


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], on: str = "date", matched_as: str | None = None
) -> DataFrame:
    """For each left row the last right *row* with the same ``by`` at or before its date.

    Both sides are stacked and read once in date order per key: linear work, where a range join is quadratic.
    A right row wins over a left row of the same date. Keys are expected to have a bounded number of rows, that
    is, right sides already reduced to one row per (key, date)."""
    carried = [c for c in right.columns if c not in by and c != on]
    kept = [c for c in left.columns if c not in by and c != on]
    r = right.select(
        *by,
        F.col(on),
        F.lit(0).alias("_side"),
        F.struct(F.col(on).alias("_on"), *carried).alias("_right"),
        F.lit(None).cast(left.select(F.struct(*kept) if kept else F.lit(1)).schema[0].dataType).alias("_left"),
    )
    l = left.select(
        *by,
        F.col(on),
        F.lit(1).alias("_side"),
        F.lit(None).cast(r.schema["_right"].dataType).alias("_right"),
        (F.struct(*kept) if kept else F.lit(1)).alias("_left"),
    )
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = r.unionByName(l).withColumn("_hit", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select(
        *by,
        on,
        *([F.col(f"_left.{c}").alias(c) for c in kept]),
        *([F.col("_hit._on").alias(matched_as)] if matched_as else []),
        *[F.col(f"_hit.{c}").alias(c) for c in carried],
    )


def asof_scan(left: DataFrame, right: DataFrame, on: str = "date", matched_as: str | None = None) -> DataFrame:
    """For each left row the last right row at or before it, without a key: a carry scan over the whole calendar.

    Both sides are cut into spans of time, about the root of the covered time in number. The last right row of every span is
    an aggregate; carried over the spans it is what a span begins with, and inside a span both sides are read in order. No task
    sees more than one span, or one row for each span. ``on`` is a date or a timestamp; a right row wins over a left row of
    the same time."""
    intraday = dict(left.dtypes)[on] != "date" or dict(right.dtypes)[on] != "date"
    at = F.unix_micros(F.col(on).cast("timestamp")) if intraday else F.unix_date(on).cast("bigint")
    carried = [c for c in right.columns if c != on]
    kept = [c for c in left.columns if c != on]
    low, high, n = right.agg(F.min(at), F.max(at), F.count("*")).first()
    width = max(1, (high - low + 1) // max(1, math.isqrt(n))) if n else 1
    span = F.floor((at - F.lit(low or 0)) / width)
    hit = F.struct(F.col(on).alias("_on"), *carried).alias("_right")
    r = right.select(span.alias("_span"), at.alias("_at"), F.lit(0).alias("_side"), hit)
    l = left.select(span.alias("_span"), at.alias("_at"), F.lit(1).alias("_side"), F.struct(on, *kept).alias("_left"))
    ends = r.groupBy("_span").agg(F.max_by("_right", "_at").alias("_end"))
    begun = l.select("_span").distinct().join(ends, "_span", "full")  # one row a span
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select("_span", F.last("_end", ignorenulls=True).over(before).alias("_begin"))
    inside = Window.partitionBy("_span").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l, allowMissingColumns=True).withColumn("_hit", F.last("_right", ignorenulls=True).over(inside))
    out = both.filter("_side = 1").join(begun, "_span").withColumn("_hit", F.coalesce("_hit", "_begin"))
    return out.select(
        *[F.col(f"_left.{c}").alias(c) for c in (on, *kept)],
        *([F.col("_hit._on").alias(matched_as)] if matched_as else []),
        *[F.col(f"_hit.{c}").alias(c) for c in carried],
    )


def prices_asof(prices: DataFrame, as_of: dt.date | Column, date: str = "date") -> DataFrame:
    """All prices of the single newest date at or before ``as_of``."""
    seen = prices.filter(F.col(date) <= as_of)
    return seen.filter(F.col(date) == seen.select(F.max(date)).scalar())


def next_dates(dates: DataFrame, date: str = "date") -> DataFrame:
    """(date, next_date) over the distinct dates. The calendar is a bounded table, hence one window partition."""
    w = Window.orderBy(date)
    return dates.select(date).distinct().select(date, F.lead(date).over(w).alias("next_date"))


def merge_measures(frames: list[DataFrame], keys: list[str] = ["date", "ticker"]) -> DataFrame:
    """Outer merge of separately computed measures: stack them and take the known value, one shuffle for all."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    measures = [c for c in out.columns if c not in keys]
    return out.groupBy(*keys).agg(*[F.max(c).alias(c) for c in measures])


def unpivot_row(df: DataFrame, columns: list[str], keys: list[str] = [], name: str = "name", value: str = "value"):
    """Columns of each row as (name, value) rows."""
    return df.unpivot(keys, columns, name, value)


def index_to_100(grid: DataFrame, value: str = "price") -> DataFrame:
    t = Rolling()
    return grid.withColumn("index_100", ratio(value, t.first_seen(value)) * 100.0)


def change_over_rows(grid: DataFrame, steps: tuple[int, ...] = (1, 21, 252), value: str = "price") -> DataFrame:
    """Return over the given numbers of rows at the newest date of the panel."""
    t = Rolling()
    newest = grid.select(F.max("date")).scalar()
    return grid.select(
        "ticker", "date", value, *[t.ret(value, n).alias(f"chg_{n}") for n in steps]
    ).filter(F.col("date") == newest)


def with_position(df: DataFrame, order: list[Column], position: str = "position") -> DataFrame:
    """The place of every row in the order in which the table is to be read or written, from 1. A stored table has no order
    of its own; whoever writes it out in order sorts by this column. End ``order`` with a unique key."""
    return rank_within(df.withColumn("_table", F.lit(1)), ["_table"], order, position).drop("_table")
