"""Profiles, coverage and other aggregates over a panel. Every one is a single pass with map-side combine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from ..functions.scalars import ratio


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing count and share, mean, std, min and max per numeric column: one aggregate row, then turned."""
    columns = columns or numeric_columns(df)
    row = df.agg(
        *[
            F.struct(
                F.count_if(F.col(c).isNull()).alias("missing_count"),
                ratio(F.count_if(F.col(c).isNull()), F.count(F.lit(1))).alias("missing_share"),
                F.avg(c).alias("mean"),
                F.stddev_samp(F.col(c).cast("double")).alias("std"),
                F.min(F.col(c).cast("double")).alias("min"),
                F.max(F.col(c).cast("double")).alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    return row.unpivot([], columns, "column", "_s").select("column", "_s.*")


def coverage_share(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return row.unpivot([], columns, "feature", "coverage")


def cluster_summary(df: DataFrame, cluster: str, error: str) -> DataFrame:
    return df.groupBy(cluster).agg(
        F.count("ticker").alias("row_count"),
        F.countDistinct("ticker").alias("ticker_count"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.avg(error).alias("avg_reconstruction_error"),
    )


def group_sizes(df: DataFrame, by: str = "date") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))


def date_constants(df: DataFrame, columns: list[str]) -> DataFrame:
    """First known value per date of columns that are constant within a date."""
    return df.groupBy("date").agg(*[F.max(c).alias(c) for c in columns])


def scoreable_dates(df: DataFrame, outcome: str = "future_1m_return", min_train: int = 36) -> DataFrame:
    """Dates with a known outcome that have at least ``min_train`` dates before them."""
    per_date = df.groupBy("date").agg(F.count(outcome).alias("labelled"))
    numbered = per_date.withColumn("position", (F.row_number().over(Window.orderBy("date")) - 1).cast("bigint"))
    return numbered.filter((F.col("labelled") > 0) & (F.col("position") >= min_train))


def sector_exposure(holdings: DataFrame, universe: DataFrame, value: str = "market_value") -> DataFrame:
    by_sector = (
        holdings.join(universe.select("ticker", "sector"), "ticker", "left")
        .groupBy(F.coalesce("sector", F.lit("Cash/Unknown")).alias("sector"))
        .agg(F.sum(value).alias(value))
    )
    total = by_sector.select(F.sum(value)).scalar()
    return by_sector.withColumn("weight", ratio(value, total))


def extremes(value: str, name: str = "ticker", best: str = "best", worst: str = "worst") -> list[Column]:
    """Aggregates for the rows with the highest and lowest value; ties go to the first name."""
    v, n = F.col(value), F.col(name)
    known = v.isNotNull()
    # min_by over (-v, name) and (v, name) so that equal values resolve by name
    return [
        F.min_by(n, F.when(known, F.struct(-v, n))).alias(f"{best}_{name}"),
        F.max(v).alias(f"{best}_{value}"),
        F.min_by(n, F.when(known, F.struct(v, n))).alias(f"{worst}_{name}"),
        F.min(v).alias(f"{worst}_{value}"),
    ]


def table_profile(df: DataFrame, name: str, date: str = "date", key: str = "ticker") -> DataFrame:
    """Rows, columns, date span and number of keys of a table, as one row."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(date).alias("min_date"),
        F.max(date).alias("max_date"),
        F.countDistinct(key).alias("tickers"),
    ).select(F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"),
             "min_date", "max_date", "tickers")


def table_profiles(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [table_profile(df, name) for name, df in tables.items()])


def membership(a: DataFrame, b: DataFrame, key: str = "ticker") -> DataFrame:
    """Each key of either side with the group it falls into: overlap, only_a or only_b."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    return left.join(right, key, "full_outer").select(
        key,
        F.when(F.col("_a") & F.col("_b"), "overlap").when(F.col("_a"), "only_a").otherwise("only_b").alias("membership"),
    )


def common_dates(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, [f.select("date") for f in frames])


def keep_members(df: DataFrame, members: DataFrame, key: list[str]) -> DataFrame:
    return df.join(members.select(*key).distinct(), key, "left_semi")


def excluding(df: DataFrame, members: DataFrame, key: list[str]) -> DataFrame:
    return df.join(members.select(*key).distinct(), key, "left_anti")


def market_state(features: DataFrame) -> DataFrame:
    """One row per date: breadth, dispersion, shares above the averages, mean volatility and drawdown, and the
    spread between sectors."""
    above = {n: F.avg((F.col(f"price_to_ma_{n}m") > 0).cast("double")) for n in (3, 6, 12)}
    by_sector = features.groupBy("date", "sector").agg(
        F.count("ret_1m").alias("n"), F.avg("ret_1m").alias("sector_ret")
    )
    dispersion = by_sector.groupBy("date").agg(F.stddev_samp("sector_ret").alias("sector_dispersion"))
    state = features.groupBy("date").agg(
        F.avg("ret_1m").alias("equal_weight_ret"),
        F.stddev_samp("ret_1m").alias("return_dispersion"),
        F.avg((F.col("ret_1m") > 0).cast("double")).alias("breadth"),
        *[a.alias(f"share_above_ma_{n}m") for n, a in above.items()],
        F.avg("vol_12m").alias("avg_vol_12m"),
        F.avg("stock_drawdown").alias("avg_drawdown"),
    )
    return state.join(dispersion, "date", "left")


def marginals(results: DataFrame, dimensions: list[str]) -> DataFrame:
    """For every value of every grid dimension: how the variants that have it did. One pass by grouping sets."""
    names = F.concat(*[F.when(F.grouping(d) == 0, F.lit(d)).otherwise(F.lit("")) for d in dimensions])
    grouped = results.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions]).agg(
        names.alias("dimension"),
        F.count("sharpe").alias("n"),
        F.avg("sharpe").alias("mean_sharpe"),
        F.median("sharpe").alias("median_sharpe"),
        F.avg("ann_return").alias("mean_ann_return"),
        F.avg("max_dd").alias("mean_max_dd"),
        F.avg("fold_sharpe_min").alias("mean_fold_min"),
    )
    return grouped.select(
        "dimension",
        F.coalesce(*[F.col(d).cast("string") for d in dimensions]).alias("value"),
        "n", "mean_sharpe", "median_sharpe", "mean_ann_return", "mean_max_dd", "mean_fold_min",
    )
