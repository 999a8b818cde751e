"""From ranks to target weights, for all dates and variants at once.

A basket holds at most top_n rows, so windows over (variant, date, branch) are bounded by that number. Anything
summed over a whole cross-section is aggregated first and joined back.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rolling import Rolling
from ..functions.scalars import clip, holds, positive, ratio
from .ranks import top_n

CASH = "CASH"


@dataclass(frozen=True)
class Branch:
    name: str
    top_n: int
    weight: float


def inverse_vol(baskets: DataFrame, by: list[str], vol: str = "vol_12m", out: str = "branch_inner_weight"):
    """Weights in proportion to 1/vol within each basket. Zero or missing volatility takes the basket's median
    inverse; a basket without any volatility is equal-weighted."""
    w = Window.partitionBy(*by)
    inv = ratio(F.lit(1.0), F.nullif(F.col(vol), F.lit(0.0)))
    filled = F.coalesce(F.col("_inv"), F.median("_inv").over(w))
    equal = F.lit(1.0) / F.count(F.lit(1)).over(w)
    return (
        baskets.withColumn("_inv", inv)
        .withColumn("_inv", filled)
        .withColumn(out, F.coalesce(ratio("_inv", F.nullif(F.sum("_inv").over(w), F.lit(0.0))), equal))
        .drop("_inv")
    )


def branch_basket(scored: DataFrame, branch: Branch, score: str = "ranker_score", vol: str = "vol_12m") -> DataFrame:
    """Top names of one branch per date with their share of the whole portfolio. ``scored`` carries the volatility."""
    ranked = top_n(
        scored.filter(F.col(score).isNotNull()), branch.top_n, ["date"], [F.col(score).desc(), F.col("ticker")]
    )
    weighted = inverse_vol(ranked, ["date"], vol)
    return weighted.select(
        "date",
        "ticker",
        F.lit(branch.name).alias("branch"),
        F.lit(branch.top_n).cast("bigint").alias("branch_top_n"),
        F.lit(branch.weight).alias("branch_weight"),
        "branch_inner_weight",
        (F.col("branch_inner_weight") * branch.weight).alias("final_weight_before_regime"),
        F.col(score).alias("ranker_score"),
        "rank_by_date",
    )


def blend(baskets: list[DataFrame]) -> DataFrame:
    """One row per (date, ticker) over all branches, weights renormalised to one per date."""
    stacked = reduce(DataFrame.unionByName, baskets)
    grouped = stacked.groupBy("date", "ticker").agg(
        F.sum("final_weight_before_regime").alias("_w"),
        # a set of branch names: bounded by the number of branches
        F.array_join(F.array_sort(F.collect_set("branch")), ", ").alias("branches"),
        F.avg("ranker_score").alias("avg_ranker_score"),
        F.min("rank_by_date").alias("best_rank"),
    )
    w = Window.partitionBy("date")
    equal = F.lit(1.0) / F.count(F.lit(1)).over(w)
    return grouped.select(
        "date",
        "ticker",
        F.coalesce(ratio("_w", F.nullif(F.sum("_w").over(w), F.lit(0.0))), equal).alias("final_weight_before_regime"),
        "branches",
        "avg_ranker_score",
        "best_rank",
    )


def regime_status(
    grid: DataFrame, universe: DataFrame, sector: str, threshold: float = -0.20, cash_weight: float = 1.0
) -> DataFrame:
    """Per date: drawdown of the sector's equal-weight index and whether it is above the threshold.

    The sector's tickers are reduced to one mean per date before anything is ordered."""
    members = universe.filter(F.col("sector") == sector).select("ticker")
    returns = Rolling()
    by_date = (
        grid.join(members, "ticker", "left_semi")
        .withColumn("_r", returns.ret("price"))
        .groupBy("date")
        # a date on which the sector has no return leaves its index where it was
        .agg(F.avg("_r").alias("_r"))
    )
    t = Rolling("_one")
    index = by_date.withColumn("_one", F.lit(1)).withColumn("_index", t.growth(F.coalesce("_r", F.lit(0.0))))
    return index.withColumn("regime_drawdown", t.drawdown("_index")).select(
        "date",
        "regime_drawdown",
        (F.col("regime_drawdown") > threshold).alias("risk_on"),
        F.lit(cash_weight).alias("cash_weight_when_off"),
    )


def apply_regime(portfolio: DataFrame, regime: DataFrame) -> DataFrame:
    """Scale stocks down where the regime is off and hold the rest as a CASH row; weights sum to one again."""
    joined = portfolio.join(regime, "date", "left")
    cash_share = F.when(holds(F.col("risk_on")), 0.0).otherwise(F.col("cash_weight_when_off"))
    with_share = joined.withColumn("_cash", F.coalesce(cash_share, F.lit(0.0)))
    stocks = with_share.withColumn("_w", F.col("final_weight_before_regime") * (1.0 - F.col("_cash")))
    cash = (
        with_share.filter("_cash > 0")
        .groupBy("date")
        .agg(F.max("_cash").alias("_w"))
        .select(
            "date",
            F.lit(CASH).alias("ticker"),
            F.lit(0.0).alias("final_weight_before_regime"),
            F.lit("regime_filter").alias("branches"),
            "_w",
        )
    )
    both = stocks.select(*portfolio.columns, "_w").unionByName(cash, allowMissingColumns=True)
    total = F.sum("_w").over(Window.partitionBy("date"))
    return both.withColumn(
        "final_weight", F.coalesce(ratio("_w", F.nullif(total, F.lit(0.0))), F.col("_w"))
    ).drop("_w")


def build_portfolio(
    scored: list[tuple[DataFrame, Branch]], regime: DataFrame | None, vol: str = "vol_12m"
) -> tuple[DataFrame, DataFrame]:
    """(final portfolio, branch detail) for every date in the scores. ``regime=None`` switches the filter off."""
    baskets = [branch_basket(df, b, vol=vol) for df, b in scored]
    combined = blend(baskets)
    detail = reduce(DataFrame.unionByName, baskets)
    if regime is None:
        return combined.withColumn("final_weight", F.col("final_weight_before_regime")), detail
    return apply_regime(combined, regime), detail


def dip_tilt(
    book: DataFrame, strength: float = 1.0, lo: float = 0.5, hi: float = 1.5,
    by: list[str] = ["date"], weight: str = "weight", ratio_to_ma: str = "ratio_to_ma",
) -> DataFrame:
    """Tilt towards names below their average, keeping each book's total. Takes a ratio near one; unknown is one."""
    w = Window.partitionBy(*by)
    mult = clip(1.0 - strength * (F.coalesce(F.col(ratio_to_ma), F.lit(1.0)) - 1.0), lo, hi)
    tilted = book.withColumn("_t", F.col(weight) * mult)
    after = F.sum("_t").over(w)
    return tilted.withColumn(
        "tilted_weight", F.when(after > 0, F.col("_t") * ratio(F.sum(weight).over(w), after)).otherwise(F.col(weight))
    ).drop("_t")


def trend_on(bench: DataFrame, window: int = 10) -> DataFrame:
    """Per date: is the benchmark at or above its trailing mean? Too little history counts as on."""
    t = Rolling("_one")
    known = bench.filter(F.col("price").isNotNull()).withColumn("_one", F.lit(1))
    ma = t.mean("price", window)
    return known.select(
        "date", ratio("price", ma).alias("price_to_ma"), F.coalesce(F.col("price") >= ma, F.lit(True)).alias("trend_on")
    )


# fixed: names of the hedge rules
HEDGES = ("none", "trend", "vix", "credit", "trend_or_credit")


def hedge_exposures(
    state: DataFrame, when_off: float = 0.4, level_cap: float = 30.0, credit_floor: float = -0.05,
    trend: str = "market_to_ma", level: str = "level", credit: str = "credit_drawdown",
) -> DataFrame:
    """(date, hedge, exposure) for the rules none, trend, vix, credit and trend_or_credit; unknown means invested."""

    def rule(off: Column) -> Column:
        return F.when(holds(off), F.lit(when_off)).otherwise(F.lit(1.0))

    wide = state.select(
        "date",
        F.lit(1.0).alias("none"),
        rule(F.col(trend) < 1.0).alias("trend"),
        rule(F.col(level) > level_cap).alias("vix"),
        rule(F.col(credit) < credit_floor).alias("credit"),
    ).withColumn("trend_or_credit", F.least("trend", "credit"))
    return wide.unpivot(["date"], list(HEDGES), "hedge", "exposure")


def hedged(
    book: DataFrame, exposures: DataFrame, weight: str = "weight", hedges: tuple[str, ...] = HEDGES
) -> DataFrame:
    """A copy of the book per hedge rule, scaled by that rule's exposure. A date without an exposure stays invested."""
    copies = book.withColumn("hedge", F.explode(F.array(*[F.lit(h) for h in hedges])))
    scaled = copies.join(exposures.select("date", "hedge", "exposure"), ["date", "hedge"], "left")
    return scaled.withColumn(weight, F.col(weight) * F.coalesce("exposure", F.lit(1.0))).drop("exposure")


def vol_target(
    returns: DataFrame, target: float = 0.15, window: int = 6, cap: float = 1.0, by: list[str] = ["series_id"]
) -> DataFrame:
    """Exposure from the volatility of the ``window`` strictly earlier months of a given return series."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(-window, -1)
    realized = F.when(F.count("ret").over(w) >= window, F.stddev_samp("ret").over(w) * F.sqrt(F.lit(12.0)))
    return returns.withColumn(
        "exposure", F.coalesce(clip(ratio(F.lit(target), positive(realized)), 0.0, cap), F.lit(1.0))
    )


def no_trade_band(target: DataFrame, drifted: DataFrame, band: float = 0.005, keys: list[str] = ["date", "ticker"]):
    """Trade only where target and drifted weight are more than ``band`` apart; empty positions are dropped."""
    both = target.select(*keys, F.col("weight").alias("_t")).join(
        drifted.select(*keys, F.col("weight").alias("_d")), keys, "full_outer"
    )
    t, d = F.coalesce("_t", F.lit(0.0)), F.coalesce("_d", F.lit(0.0))
    actual = F.when(F.abs(t - d) > band, t).otherwise(d)
    return both.select(*keys, t.alias("target_weight"), d.alias("drifted_weight"), actual.alias("weight")).filter(
        F.col("weight") != 0.0
    )


def rank_buffer(ranked: DataFrame, enter: int = 20, leave: int = 40, rank: str = "rank_by_date") -> DataFrame:
    """Names held under inertia: in at rank <= enter, out only at rank > leave (or when unranked).

    The state is the last entering or leaving event of the ticker, so no row depends on a computed one."""
    event = F.when(F.col(rank) <= enter, True).when(F.col(rank).isNull() | (F.col(rank) > leave), False)
    t = Rolling()
    return ranked.withColumn("_event", event).withColumn("held", holds(t.fill("_event"))).drop("_event")


def sector_capped(ranked: DataFrame, n: int, per_sector: int, score: str = "ranker_score") -> DataFrame:
    """Best n per date with at most ``per_sector`` from one sector."""
    order = [F.col(score).desc(), F.col("ticker")]
    within = top_n(ranked, per_sector, ["date", "sector"], order, "sector_rank")
    return top_n(within, n, ["date"], order, "rank_by_date")
