"""One feature row per (ticker, date): own history, benchmark, sector, and daily-bar features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.frames import Frames
from ..functions.rolling import Rolling
from ..functions.scalars import clip, holds, positive, ratio
from .shape import asof_join, asof_scan, bounded_fill

RETURN_WINDOWS = (1, 3, 6, 12)
MA_WINDOWS = (3, 6, 12)
VOL_WINDOWS = (3, 6, 12)
DRAWDOWN_WINDOWS = (6, 12)
PERIODS_PER_YEAR_DAILY = 252


def stock_features(grid: DataFrame, fill: str = "none") -> DataFrame:
    """Trailing returns, averages, volatilities, drawdowns and the next return, on the dense grid.

    Two window steps, because volatilities and the label look at the one-row return; both use the ticker
    partitioning the grid already has, so neither adds an exchange."""
    t = Rolling()
    price = F.col("_p")
    base = grid.withColumn("_p", t.fill("price") if fill == "pad" else F.col("price"))
    first = base.select(
        *grid.columns,
        *[t.ret(price, n).alias(f"ret_{n}m") for n in RETURN_WINDOWS],
        *[t.mean("price", n).alias(f"price_ma_{n}m") for n in MA_WINDOWS],
        *[t.rolling_drawdown("price", n).alias(f"stock_drawdown_{n}m") for n in DRAWDOWN_WINDOWS],
        F.when(F.col("price").isNotNull(), t.drawdown("price")).alias("stock_drawdown"),
    )
    return first.select(
        "*",
        *[(ratio("price", f"price_ma_{n}m") - 1.0).alias(f"price_to_ma_{n}m") for n in MA_WINDOWS],
        *[t.std("ret_1m", n).alias(f"vol_{n}m") for n in VOL_WINDOWS],
        t.lead("ret_1m").alias("future_1m_return"),
    )


def benchmark_features(bench: DataFrame) -> DataFrame:
    """The same on the benchmark's (date, price): one row per date, so one window partition is small."""
    t = Rolling("_one")
    one = bench.select("date", F.col("price").alias("bench_price"), F.lit(1).alias("_one"))
    first = one.select("*", *[t.ret("bench_price", n).alias(f"bench_ret_{n}m") for n in RETURN_WINDOWS])
    return first.select(
        "date",
        "bench_price",
        *[f"bench_ret_{n}m" for n in RETURN_WINDOWS],
        *[t.std("bench_ret_1m", n).alias(f"bench_vol_{n}m") for n in VOL_WINDOWS],
        t.drawdown("bench_price").alias("bench_drawdown"),
        t.lead("bench_ret_1m").alias("future_1m_bench_return"),
    )


def with_benchmark(features: DataFrame, bench: DataFrame) -> DataFrame:
    """Benchmark features by date, and the label: an unknown excess return counts as not outperforming."""
    out = features.join(benchmark_features(bench), "date", "left")
    excess = F.col("future_1m_return") - F.col("future_1m_bench_return")
    return out.withColumn("future_1m_excess_return", excess).withColumn(
        "target_outperform_1m", holds(excess > 0).cast("double")
    )


def group_means(df: DataFrame, by: list[str], columns: list[str], prefix: str) -> DataFrame:
    """Mean of each column per group, joined back. Groups are averaged with map-side combine, so a sector that
    holds most of a date is no hot task."""
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"{prefix}_{c}") for c in columns])
    return df.join(means, by, "left")


def sector_features(df: DataFrame) -> DataFrame:
    columns = [f"ret_{n}m" for n in RETURN_WINDOWS]
    out = group_means(df, ["date", "sector"], columns, "sector")
    return out.select("*", *[(F.col(c) - F.col(f"sector_{c}")).alias(f"{c}_minus_sector") for c in columns])


def indicator_columns(df: DataFrame, columns: list[str], values: dict[str, list[str]] | None = None) -> DataFrame:
    """0/1 columns per value (sector_*, industry_*). ``values`` names them per column; a column that is not named there
    gets one for each value it has, read once, since a table's columns must be known when it is planned."""
    out = df
    for c in columns:
        found = (values or {}).get(c)
        if found is None:
            found = sorted(r[0] for r in df.select(c).distinct().filter(F.col(c).isNotNull()).toLocalIterator())
        out = out.select("*", *[holds(F.col(c) == v).cast("int").alias(f"{c}_{v}") for v in found])
    return out


def indicator_rows(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The same in long form for wide vocabularies: (keys, indicator), one row per indicator that is 1."""
    marks = F.array(*[F.when(F.col(c).isNotNull(), F.concat_ws("_", F.lit(c), F.col(c).cast("string"))) for c in columns])
    return df.select(*keys, F.explode(F.array_compact(marks)).alias("indicator"))


def drop_unpriced(df: DataFrame, benchmark: str | None = None) -> DataFrame:
    out = df.filter(F.col("price").isNotNull())
    return out if benchmark is None else out.filter(F.col("ticker") != benchmark)


def visible(df: DataFrame, as_of, date: str = "date") -> DataFrame:
    return df.filter(F.col(date) <= as_of)


def trainable(df: DataFrame, before, outcome: str = "future_1m_return", date: str = "date") -> DataFrame:
    return df.filter((F.col(date) < before) & F.col(outcome).isNotNull())


def daily_returns(bars: DataFrame) -> DataFrame:
    """Daily bars with the one-row return; gaps are carried forward, as daily closes are."""
    t = Rolling()
    return bars.withColumn("_c", t.fill("close")).withColumn("dret", t.ret("_c")).drop("_c")


KEYS = ("ticker", "date")


def _liquidity(t: Frames, short: int = 21, mid: int = 63, long: int = 252, min_obs: int = 40) -> list[Column]:
    t.add("_dv", F.col("close") * F.col("volume"))
    t.add("_impact", ratio(F.abs("dret"), F.nullif("_dv", F.lit(0.0))))
    return [
        F.log(clip(t.mean("_dv", short), lo=1.0)).alias("v3_log_dollar_vol_1m"),
        ratio(t.mean("volume", mid), t.mean("volume", long)).alias("v3_volume_ratio_3m_12m"),
        (t.mean("_impact", mid, min_obs) * 1e9).alias("v3_amihud_3m"),
    ]


def _range(t: Frames, short: int = 21, mid: int = 63, min_down: int = 20) -> list[Column]:
    year = math.sqrt(PERIODS_PER_YEAR_DAILY)
    log_range = F.log(clip(ratio("high", "low"), lo=1.0))
    t.add("_hl2", log_range * log_range)
    t.add("_down", F.when(F.col("dret") < 0, F.col("dret")))

    def parkinson(n):
        return F.sqrt(t.mean("_hl2", n) / (4.0 * math.log(2.0))) * year

    return [
        parkinson(short).alias("v3_parkinson_vol_1m"),
        parkinson(mid).alias("v3_parkinson_vol_3m"),
        ratio(t.max("high", short) - t.min("low", short), "close").alias("v3_intramonth_range"),
        (t.std("_down", mid, min_down) * year).alias("v3_downside_vol_3m"),
    ]


def _shape(t: Frames, short: int = 21, mid: int = 63, min_obs: int = 40) -> list[Column]:
    return [
        t.skew("dret", mid, min_obs).alias("v3_ret_skew_3m"),
        t.kurt("dret", mid, min_obs).alias("v3_ret_kurt_3m"),
        t.max("dret", short).alias("v3_max_daily_ret_1m"),
        t.min("dret", short).alias("v3_min_daily_ret_1m"),
    ]


def _position(t: Frames, year: int = 252, fast: int = 50, slow: int = 200) -> list[Column]:
    return [
        (ratio("close", t.max("close", year)) - 1.0).alias("v3_pct_from_52w_high"),
        (ratio("close", t.min("close", year)) - 1.0).alias("v3_pct_from_52w_low"),
        ratio("close", t.mean("close", fast)).alias(f"v3_price_to_ma{fast}"),
        ratio("close", t.mean("close", slow)).alias(f"v3_price_to_ma{slow}"),
        ratio(t.mean("close", fast), t.mean("close", slow)).alias(f"v3_ma{fast}_over_ma{slow}"),
    ]


def _market(t: Frames, year: int = 252, half: int = 126) -> list[Column]:
    return [
        ratio(t.cov("dret", "bench_dret", year), t.var("bench_dret", year)).alias("v3_beta_12m"),
        t.corr("dret", "bench_dret", half).alias("v3_corr_6m"),
    ]


def _left_over(df: DataFrame, keep, half: int = 126, min_resid: int = 60) -> DataFrame:
    """``df`` plus the volatility of what the row's own beta leaves of its return."""
    t = Frames(df)
    t.add("_resid", F.col("dret") - F.col("v3_beta_12m") * F.col("bench_dret"))
    volatility = (t.std("_resid", half, min_resid) * math.sqrt(PERIODS_PER_YEAR_DAILY)).alias("v3_idio_vol_6m")
    return t.done().select(*keep, volatility)


def liquidity_features(bars: DataFrame, short: int = 21, mid: int = 63, long: int = 252, min_obs: int = 40, keep=KEYS) -> DataFrame:
    t = Frames(bars)
    found = _liquidity(t, short, mid, long, min_obs)
    return t.done().select(*keep, *found)


def range_features(bars: DataFrame, short: int = 21, mid: int = 63, min_down: int = 20, keep=KEYS) -> DataFrame:
    t = Frames(bars)
    found = _range(t, short, mid, min_down)
    return t.done().select(*keep, *found)


def shape_features(bars: DataFrame, short: int = 21, mid: int = 63, min_obs: int = 40, keep=KEYS) -> DataFrame:
    t = Frames(bars)
    found = _shape(t, short, mid, min_obs)
    return t.done().select(*keep, *found)


def position_features(bars: DataFrame, year: int = 252, fast: int = 50, slow: int = 200, keep=KEYS) -> DataFrame:
    t = Frames(bars)
    found = _position(t, year, fast, slow)
    return t.done().select(*keep, *found)


def market_features(
    bars: DataFrame, bench_returns: DataFrame, year: int = 252, half: int = 126, min_resid: int = 60, keep=KEYS
) -> DataFrame:
    """Beta and correlation to the benchmark's (date, bench_dret), and the volatility of what beta leaves over."""
    t = Frames(bars.join(bench_returns, "date", "left"))
    found = _market(t, year, half)
    first = t.done().select(*dict.fromkeys([*keep, *KEYS, "dret", "bench_dret"]), *found)
    return _left_over(first, [*keep, "v3_beta_12m", "v3_corr_6m"], half, min_resid)


def daily_features(bars: DataFrame, bench_returns: DataFrame) -> DataFrame:
    """All daily-bar features on one partitioning by ticker; all frames but the last share the lags of their tables."""
    t = Frames(daily_returns(bars).join(bench_returns, "date", "left"))
    found = [c for part in (_liquidity, _range, _shape, _position, _market) for c in part(t)]
    first = t.done().select(*KEYS, "dret", "bench_dret", *found)
    made = [c for c in first.columns if c.startswith("v3_")]
    return _left_over(first, [*KEYS, *made])


def period_snapshot(daily: DataFrame, ends: DataFrame, limit: int = 7) -> DataFrame:
    """Daily features on the given (ticker, date) period ends: filled for at most ``limit`` rows, then the last row
    at or before the end."""
    filled = bounded_fill(daily, [c for c in daily.columns if c not in KEYS], limit)
    return asof_join(ends, filled, ["ticker"])


def macro_wide(macro: DataFrame, series: list[str]) -> DataFrame:
    """(date, series, value) with one column per listed series; the list is given, so no extra job is run."""
    return macro.groupBy("date").pivot("series", series).agg(F.max("value"))


def macro_month_ends(wide: DataFrame, limit: int = 7) -> DataFrame:
    """Daily levels at month ends: gaps filled for at most ``limit`` rows, then the last row at or before each end.

    The months run from the first to the last with a row; one row per date and month, so the windows are calendar-sized."""
    series = [c for c in wide.columns if c != "date"]
    t = Rolling("_one")
    filled = wide.withColumn("_one", F.lit(1)).select("date", *[t.fill(c, limit).alias(c) for c in series])
    span = filled.agg(F.min(F.last_day("date")).alias("a"), F.max(F.last_day("date")).alias("b"))
    months = F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("INTERVAL 1 MONTH"))
    ends = span.select(F.explode(F.transform(months, F.last_day)).alias("date"))
    return asof_scan(ends, filled)


def macro_monthly(m: DataFrame, names: dict[str, str]) -> DataFrame:
    """Fourteen monthly columns out of levels at month ends (one row per month).

    ``names`` says which series is fear, long_yield, short_yield, bonds, gold, risky, safe, large, small and market."""
    s = {k: F.col(v) for k, v in names.items()}
    t = Rolling("_one")
    df = m.withColumn("_one", F.lit(1)).withColumn("_spread", s["long_yield"] - s["short_yield"])
    ret = lambda k: t.ret(names[k], 3)
    fear, market = names["fear"], names["market"]
    return df.select(
        "date",
        s["fear"].alias("v3m_fear"),
        t.change(fear, 1).alias("v3m_fear_chg_1m"),
        ratio(F.col(fear) - t.mean(fear, 12), t.std(fear, 12)).alias("v3m_fear_z_12m"),
        s["long_yield"].alias("v3m_long_yield"),
        s["short_yield"].alias("v3m_short_yield"),
        F.col("_spread").alias("v3m_term_spread"),
        t.change("_spread", 3).alias("v3m_term_spread_chg_3m"),
        ret("bonds").alias("v3m_bonds_ret_3m"),
        ret("gold").alias("v3m_gold_ret_3m"),
        ret("risky").alias("v3m_risky_ret_3m"),
        (ret("risky") - ret("safe")).alias("v3m_credit_appetite_3m"),
        t.drawdown(names["risky"]).alias("v3m_risky_drawdown"),
        (ret("large") - ret("small")).alias("v3m_large_minus_small_3m"),
        ratio(market, t.mean(market, 10)).alias("v3m_market_to_ma10m"),
    )


def widened(base: DataFrame, daily_at_ends: DataFrame, macro_at_ends: DataFrame) -> DataFrame:
    """The base features with those of daily bars, on (date, ticker), and of macro series, on the date. Rows of the base stay."""
    return base.join(daily_at_ends, ["date", "ticker"], "left").join(macro_at_ends, "date", "left")


def macro_features(
    wide: DataFrame,
    level: str,
    high_yield: str,
    short_yield: str,
    risky: str,
    safe: str,
    market: str,
    steps: tuple[int, int] = (1, 3),
    z_window: int = 12,
    ma_window: int = 10,
) -> DataFrame:
    """Level, change and z-score of one series, a yield spread, returns and their spreads, drawdown, trend ratio.

    One row per date: the window over the whole calendar is a single small partition by design."""
    t = Rolling("_one")
    a, b = steps
    df = wide.withColumn("_one", F.lit(1)).withColumn("_spread", F.col(high_yield) - F.col(short_yield))
    return df.select(
        "date",
        F.col(level).alias("v3m_level"),
        t.change(level, a).alias("v3m_level_chg"),
        ratio(F.col(level) - t.mean(level, z_window), t.std(level, z_window)).alias("v3m_level_z"),
        F.col("_spread").alias("v3m_spread"),
        t.change("_spread", b).alias("v3m_spread_chg"),
        t.ret(risky, b).alias("v3m_risky_ret"),
        (t.ret(risky, b) - t.ret(safe, b)).alias("v3m_appetite"),
        t.drawdown(risky).alias("v3m_risky_drawdown"),
        ratio(market, t.mean(market, ma_window)).alias("v3m_market_to_ma"),
    )
