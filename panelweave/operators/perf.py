"""Realised returns, turnover, cost and the statistics of return series, keyed so that thousands go at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rolling import Rolling
from ..functions.scalars import holds, positive, ratio
from ..plans.staging import pick
from .construct import CASH

MONTHS = 12
INF = float("inf")


def attach_returns(book: DataFrame, realized: DataFrame) -> DataFrame:
    """Book rows with the return of their period. Cash earns zero; a missing return stays NULL here."""
    r = pick(realized.select("date", "ticker", F.col("future_1m_return").alias("ret")), book, ["date", "ticker"])
    return book.join(r, ["date", "ticker"], "left").withColumn(
        "ret", F.when(F.col("ticker") == CASH, F.lit(0.0)).otherwise(F.col("ret"))
    )


def gross_returns(held: DataFrame, by: list[str] = ["date"], weight: str = "weight") -> DataFrame:
    """Weighted return per date; missing returns count as zero and their weight is reported."""
    cash = F.col("ticker") == CASH
    return held.groupBy(*by).agg(
        F.sum(F.col(weight) * F.coalesce("ret", F.lit(0.0))).alias("gross_return"),
        F.count_if(~cash).alias("n_positions"),
        F.coalesce(F.sum(F.when(cash, F.col(weight))), F.lit(0.0)).alias("cash_weight"),
        F.coalesce(F.sum(F.when(F.col("ret").isNull(), F.col(weight))), F.lit(0.0)).alias("missing_return_weight"),
    )


def _next_dates(held: DataFrame, by: list[str]) -> DataFrame:
    """(by..., date, next_date, first?) per book; one row per rebalance date and variant."""
    w = Window.partitionBy(*by).orderBy("date") if by else Window.orderBy("date")
    return held.select(*by, "date").distinct().withColumn("next_date", F.lead("date").over(w))


def drifted(held: DataFrame, by: list[str] = [], weight: str = "weight") -> DataFrame:
    """Each date's book after its realised returns, dated on the next rebalance.

    With stocks only, the cash that is left over keeps its value: the divisor is 1 + gross return. A book whose
    weights sum to one including CASH gives the same numbers."""
    keys = [*by, "date"]
    r = F.coalesce("ret", F.lit(0.0))
    gross = held.groupBy(*keys).agg(F.sum(F.col(weight) * r).alias("_gross"))
    per_date = gross.join(_next_dates(held, by), keys)
    return (
        held.join(per_date, keys)
        .filter(F.col("next_date").isNotNull())
        .select(
            *by,
            F.col("next_date").alias("date"),
            "ticker",
            ratio(F.col(weight) * (1.0 + r), 1.0 + F.col("_gross")).alias(weight),
        )
    )


def turnover(held: DataFrame, by: list[str] = [], weight: str = "weight") -> DataFrame:
    """Two-way turnover per date, without cash; the first date pays for the whole purchase.

    Only one lag is involved: targets and drifted books are stacked with opposite signs and summed per ticker."""
    keys = [*by, "date"]
    target = held.select(*keys, "ticker", weight)
    minus = drifted(held, by, weight).withColumn(weight, -F.col(weight))
    trades = (
        target.unionByName(minus)
        .filter(F.col("ticker") != CASH)
        .groupBy(*keys, "ticker")
        .agg(F.sum(weight).alias("_trade"))
        .groupBy(*keys)
        .agg(F.sum(F.abs("_trade")).alias("turnover"))
    )
    # a date with nothing held and nothing to sell still has a (zero) turnover
    dates = held.select(*keys).distinct()
    return dates.join(trades, keys, "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))


def net_returns(held: DataFrame, cost_rate: float = 0.001, by: list[str] = [], weight: str = "weight") -> DataFrame:
    keys = [*by, "date"]
    out = gross_returns(held, keys, weight).join(turnover(held, by, weight), keys)
    return out.withColumn("cost", F.col("turnover") * cost_rate).withColumn(
        "net_return", F.col("gross_return") - F.col("cost")
    )


def ann_return(r: Column) -> Column:
    growth = F.product(1.0 + r)
    return F.when(F.count(r) > 0, F.when(growth <= 0, F.lit(-1.0)).otherwise(F.pow(growth, F.lit(MONTHS) / F.count(r)) - 1.0))


def ann_vol(r: Column) -> Column:
    return F.when(F.count(r) >= 2, F.stddev_samp(r) * F.sqrt(F.lit(float(MONTHS))))


def sharpe(r: Column) -> Column:
    return F.when(F.count(r) >= 2, ratio(F.avg(r), positive(F.stddev_samp(r))) * F.sqrt(F.lit(float(MONTHS))))


def sortino(r: Column) -> Column:
    losses = F.count_if(r < 0)
    dev = F.sqrt(F.avg(F.when(r < 0, r * r)))
    value = F.when(losses == 0, F.lit(INF)).otherwise(ratio(F.avg(r), positive(dev)) * F.sqrt(F.lit(float(MONTHS))))
    return F.when(F.count(r) >= 2, value)


def summarize(returns: DataFrame, by: list[str], ret: str = "ret", bench: str | None = None) -> DataFrame:
    """One row of statistics per series. Missing returns are left out; with ``bench`` also the relative ones."""
    known = returns.filter(F.col(ret).isNotNull())
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    r = F.col(ret)
    curve = known.withColumn("_equity", F.product(1.0 + r).over(w)).withColumn(
        "_dd", ratio("_equity", F.max("_equity").over(w)) - 1.0
    )
    aggs = [
        F.count(r).alias("months"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        (F.product(1.0 + r) - 1.0).alias("total_return"),
        ann_return(r).alias("ann_return"),
        ann_vol(r).alias("ann_vol"),
        sharpe(r).alias("sharpe"),
        sortino(r).alias("sortino"),
        F.min("_dd").alias("max_dd"),
        F.max(r).alias("best_month"),
        F.min(r).alias("worst_month"),
        F.avg((r > 0).cast("double")).alias("positive_share"),
    ]
    if bench:
        active = r - F.col(bench)
        aggs += [
            sharpe(active).alias("information_ratio"),
            F.avg(F.when(active.isNotNull(), (r > F.col(bench)).cast("double"))).alias("hit_rate"),
        ]
    return curve.groupBy(*by).agg(*aggs)


def with_folds(returns: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Contiguous folds 1..k over each series' dates; sizes differ by at most one, the larger ones first."""
    w = Window.partitionBy(*by).orderBy("date")
    return returns.withColumn("fold", F.ntile(k).over(w).cast("bigint"))


def by_fold(returns: DataFrame, k: int, by: list[str], ret: str = "ret", bench: str | None = None) -> DataFrame:
    return summarize(with_folds(returns.filter(F.col(ret).isNotNull()), k, by), [*by, "fold"], ret, bench)


def by_year(returns: DataFrame, by: list[str], ret: str = "ret", bench: str | None = None) -> DataFrame:
    return summarize(returns.withColumn("year", F.year("date").cast("bigint")), [*by, "year"], ret, bench)


def fold_dispersion(folds: DataFrame, by: list[str]) -> DataFrame:
    return folds.groupBy(*by).agg(
        F.avg("sharpe").alias("fold_sharpe_mean"),
        F.stddev_samp("sharpe").alias("fold_sharpe_std"),
        F.min("sharpe").alias("fold_sharpe_min"),
    )


def compare_variants(net: DataFrame, bench: DataFrame, k: int, by: str = "variant") -> DataFrame:
    """Statistics, mean turnover, yearly cost and fold dispersion per variant, and a row for the benchmark."""
    series = net.select(by, "date", F.col("net_return").alias("ret")).join(bench, "date", "left")
    own = bench.select(F.lit("buy_and_hold").alias(by), "date", F.col("bench_ret").alias("ret")).withColumn(
        "bench_ret", F.lit(None).cast("double")
    )
    stacked = series.select(by, "date", "ret", "bench_ret").unionByName(own)
    stats = summarize(stacked, [by], bench="bench_ret")
    folds = fold_dispersion(by_fold(stacked, k, [by]), [by])
    trading = net.groupBy(by).agg(
        F.avg("turnover").alias("avg_turnover"), (F.avg("cost") * MONTHS).alias("avg_cost_annualized")
    )
    return stats.join(folds, by).join(trading, by, "left")


def cumulative(perf: DataFrame, starting_cash: float, by: list[str] = ["model_name"]) -> DataFrame:
    """Running values of portfolio and benchmark, the gap between them and the portfolio's drawdown."""
    t = Rolling(by, "signal_date")
    out = perf.withColumn("portfolio_value", starting_cash * t.growth("portfolio_return")).withColumn(
        "bench_value", starting_cash * t.growth("bench_return")
    )
    return (
        out.withColumn("portfolio_cum_return", F.col("portfolio_value") / starting_cash - 1.0)
        .withColumn("bench_cum_return", F.col("bench_value") / starting_cash - 1.0)
        .withColumn("cum_excess_return", F.col("portfolio_cum_return") - F.col("bench_cum_return"))
        .withColumn("portfolio_drawdown", t.drawdown("portfolio_value"))
    )


def evaluate_periods(signals: DataFrame, prices: DataFrame, bench: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per model and signal date, one row per holding) from the signal date to the next price date.

    Start and end are the newest price dates at or before the signal and the evaluation date. A holding without
    both prices drops out of the return and is listed. Signals of the last date have no end yet and do not appear."""
    from .shape import asof_scan

    # date-level tables: one row per calendar date
    lead = Window.orderBy("date")
    calendar = prices.select("date").distinct().select(
        "date",
        F.col("date").alias("signal_price_date"),
        F.lead("date").over(lead).alias("evaluation_date"),
    )
    asked = signals.select(F.col("signal_date").alias("date")).distinct()
    span = (
        asof_scan(asked, calendar)
        .select(F.col("date").alias("signal_date"), "signal_price_date", "evaluation_date")
        .filter(F.col("evaluation_date").isNotNull())
    )
    held = signals.join(span, "signal_date")
    # only the prices of held names at the ends of their period leave the panel
    p0 = pick(
        prices.select(F.col("date").alias("signal_price_date"), "ticker", F.col("price").alias("start_price")),
        held, ["signal_price_date", "ticker"],
    )
    p1 = pick(
        prices.select(F.col("date").alias("evaluation_date"), "ticker", F.col("price").alias("end_price")),
        held, ["evaluation_date", "ticker"],
    )
    stock_ret = ratio("end_price", positive("start_price")) - 1.0
    detail = (
        held.join(p0, ["signal_price_date", "ticker"], "left")
        .join(p1, ["evaluation_date", "ticker"], "left")
        .withColumn("holding_return", F.when(F.col("ticker") == CASH, F.lit(0.0)).otherwise(stock_ret))
        .withColumn("contribution", F.col("final_weight") * F.col("holding_return"))
    )
    b0 = bench.select(F.col("date").alias("signal_price_date"), F.col("price").alias("_b0"))
    b1 = bench.select(F.col("date").alias("evaluation_date"), F.col("price").alias("_b1"))
    bench_span = (
        span.join(b0, "signal_price_date", "left")
        .join(b1, "evaluation_date", "left")
        .select("signal_date", (ratio("_b1", positive("_b0")) - 1.0).alias("bench_return"))
    )
    stock = F.col("ticker") != CASH
    sr = F.when(stock, F.col("holding_return"))
    known = sr.isNotNull()
    gone = F.when(stock & F.col("holding_return").isNull(), F.col("ticker"))
    period = (
        detail.groupBy("model_name", "signal_date", "signal_price_date", "evaluation_date")
        .agg(
            F.coalesce(F.sum("contribution"), F.lit(0.0)).alias("portfolio_return"),
            F.count_if(stock).alias("holding_count"),
            F.coalesce(F.sum(F.when(~stock, F.col("final_weight"))), F.lit(0.0)).alias("cash_weight"),
            F.coalesce(F.min_by("ticker", F.when(known, F.struct(-sr, F.col("ticker")))), F.lit("NONE")).alias("best_ticker"),
            F.max(sr).alias("best_holding_return"),
            F.coalesce(F.min_by("ticker", F.when(known, F.struct(sr, F.col("ticker")))), F.lit("NONE")).alias("worst_ticker"),
            F.min(sr).alias("worst_holding_return"),
            # one book's names: bounded by the basket size
            F.array_join(F.array_sort(F.collect_list(gone)), ", ").alias("missing_tickers"),
        )
        .join(bench_span, "signal_date", "left")
        .withColumn("excess_return", F.col("portfolio_return") - F.col("bench_return"))
        .withColumn("beat_bench", holds(F.col("excess_return") > 0))
    )
    return period, detail
