"""Operators that the research notes describe: sector scores, buckets, horizons, overlapping baskets, stress tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.rolling import Rolling
from ..functions.scalars import holds, positive, ratio
from .ranks import rank_within, top_n


def sector_scores(df: DataFrame, columns: list[str], by: str = "sector") -> DataFrame:
    """Each column minus its sector mean, and that in units of the sector's standard deviation, per date."""
    stats = df.groupBy("date", by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns]
    )
    out = df.join(stats, ["date", by], "left")
    for c in columns:
        gap = F.col(c) - F.col(f"_m_{c}")
        out = out.withColumn(f"{c}_minus_{by}", gap).withColumn(f"{c}_{by}_z", ratio(gap, positive(f"_s_{c}")))
    return out.drop(*[f"_{p}_{c}" for p in "ms" for c in columns])


def size_buckets(df: DataFrame, value: str, edges: list[tuple[str, float]], top: str) -> DataFrame:
    """Named ranges: the first whose upper edge (exclusive) is above the value, else ``top``."""
    out = F.lit(top)
    for name, edge in reversed(edges):
        out = F.when(F.col(value) < edge, name).otherwise(out)
    return df.withColumn("size_bucket", F.when(F.col(value).isNotNull(), out))


def forward_targets(grid: DataFrame, horizons: tuple[int, ...] = (1, 3, 6, 12, 24, 36), value: str = "price"):
    t = Rolling()
    return grid.select("*", *[(ratio(t.lead(value, h), value) - 1.0).alias(f"future_{h}m_return") for h in horizons])


def top_fifth(df: DataFrame, value: str = "future_1m_return", out: str = "target_top_quintile_1m", **kw) -> DataFrame:
    """1 for the rows whose rank share within the date is above 0.8."""
    ranked = rank_within(df.filter(F.col(value).isNotNull()), ["date"], [F.col(value), F.col("ticker")], "_r", "_n", **kw)
    return ranked.withColumn(out, (F.col("_r") / F.col("_n") > 0.8).cast("int")).drop("_r", "_n")


def overlapping_baskets(picks: DataFrame, returns: DataFrame, horizon: int) -> DataFrame:
    """Monthly return when each month's basket is held for ``horizon`` months: the mean over the live baskets.

    ``picks`` has date and ticker; ``returns`` the return of the month that ends on date. Each pick is spread over
    its months and joined by (date, ticker), so no range join is needed."""
    live = picks.select(F.col("date").alias("formed"), "ticker").withColumn(
        "date", F.explode(F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.last_day(F.add_months("formed", i))))
    )
    basket = (
        live.join(returns.select("date", "ticker", F.col("ret_1m").alias("ret")), ["date", "ticker"])
        .groupBy("date", "formed")
        .agg(F.avg("ret").alias("basket_ret"))
        .filter("basket_ret is not null")
    )
    return basket.groupBy("date").agg(F.avg("basket_ret").alias("ret"), F.count(F.lit(1)).alias("live_baskets"))


def low_vol_top_n(df: DataFrame, n: int, max_vol: float = 0.20, vol: str = "vol_12m", score: str = "ranker_score"):
    """Top n by score among names whose volatility is below the limit."""
    return top_n(df.filter(F.col(vol) < max_vol), n, ["date"], [F.col(score).desc(), F.col("ticker")])


def vol_universes(df: DataFrame, vol: str = "vol_12m", **kw) -> DataFrame:
    """Rank by volatility within the date, and the low / mid / high third it falls into."""
    ranked = rank_within(df.filter(F.col(vol).isNotNull()), ["date"], [F.col(vol), F.col("ticker")], "vol_rank", "_n", **kw)
    share = F.col("vol_rank") / F.col("_n")
    return ranked.withColumn(
        "vol_bucket", F.when(share <= 1 / 3, "low").when(share <= 2 / 3, "mid").otherwise("high")
    ).drop("_n")


def leadership(df: DataFrame, windows: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    """Sector and industry returns against the benchmark, stock against both, and the groups' ranks by date.

    Group means are aggregated first; the ranks are taken over one row per (date, group)."""
    out = df
    for level in ("sector", "industry"):
        means = df.groupBy("date", level).agg(*[F.avg(f"ret_{n}m").alias(f"{level}_ret_{n}m") for n in windows])
        w = Window.partitionBy("date").orderBy(F.col(f"{level}_ret_{windows[-1]}m").desc_nulls_last(), level)
        means = means.withColumn(f"{level}_rank_by_date", F.row_number().over(w).cast("bigint"))
        out = out.join(means, ["date", level], "left")
        for n in windows:
            out = out.withColumn(f"{level}_minus_bench_{n}m", F.col(f"{level}_ret_{n}m") - F.col(f"bench_ret_{n}m"))
            out = out.withColumn(f"stock_minus_{level}_{n}m", F.col(f"ret_{n}m") - F.col(f"{level}_ret_{n}m"))
    return out


def strength_rules(df: DataFrame, sector: str) -> DataFrame:
    """Per date, risk-on under each relative-strength rule of one sector; unknown counts as on."""
    by_date = (
        df.filter(F.col("sector") == sector)
        .groupBy("date")
        .agg(
            F.avg("ret_6m").alias("sector_6m"), F.avg("ret_12m").alias("sector_12m"),
            F.max("bench_ret_6m").alias("bench_6m"), F.max("bench_ret_12m").alias("bench_12m"),
        )
    )
    return by_date.select(
        "date",
        (~holds(F.col("sector_6m") < F.col("bench_6m"))).alias("on_6m_vs_bench"),
        (~holds(F.col("sector_12m") < F.col("bench_12m"))).alias("on_12m_vs_bench"),
        (~holds(F.col("sector_6m") < 0)).alias("on_6m_positive"),
    )


def interactions(df: DataFrame, features: list[str], state: list[str]) -> DataFrame:
    """Products of each feature with each date-level state column."""
    return df.select("*", *[(F.col(f) * F.col(s)).alias(f"{f}_x_{s}") for f in features for s in state])


def cluster_flags(df: DataFrame, k: int, cluster: str = "cluster") -> DataFrame:
    return df.select("*", *[(F.col(cluster) == i).cast("int").alias(f"cluster_{i}") for i in range(k)])


def pick_counts(picks: DataFrame) -> DataFrame:
    return picks.groupBy("ticker").agg(F.count(F.lit(1)).alias("times_picked"))


def most_picked(picks: DataFrame, n: int) -> DataFrame:
    """The n most frequent picks, for runs that ban them."""
    return pick_counts(picks).orderBy(F.desc("times_picked"), "ticker").limit(n)


def sector_share_by_year(picks: DataFrame, universe: DataFrame) -> DataFrame:
    counts = (
        picks.join(universe.select("ticker", "sector"), "ticker", "left")
        .groupBy(F.year("date").cast("bigint").alias("year"), "sector")
        .agg(F.count(F.lit(1)).alias("picks"))
    )
    return counts.withColumn("share", F.col("picks") / F.sum("picks").over(Window.partitionBy("year")))
