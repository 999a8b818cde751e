"""Queries on price panels: period ends, grids, fills, as-of reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import Rolling
from ..operators import shape
from ..plans.staging import new_path, stage
from ..sources import adapters as A
from ..sources.tables import (
    read_features,
    read_ledger,
    read_ohlcv,
    read_or_empty,
    select_field,
    universe_keys,
    unpivot_panel,
    write_table,
)
from . import fixtures as X
from .registry import query


@query(
    "month_end_prices",
    f"""WITH {X.BARS} SELECT ticker, last_day(date) AS date, arg_max(close, date) AS price FROM bars
WHERE close IS NOT NULL GROUP BY 1, 2
HAVING last_day(date) <= (SELECT last_day(max(date) - INTERVAL 1 MONTH) FROM bars)""",
    "price",
)
def month_end_prices(spark, sf):
    bars = stage(A.daily_bars(spark, sf), "daily-bars")
    closed = shape.month_end(bars, value="close").withColumnRenamed("close", "price")
    return shape.completed_only(closed, bars.select(F.max("date")).scalar())


@query(
    "monthly_returns",
    f"""WITH {X.GRID} SELECT date, ticker, r AS monthly_return FROM
(SELECT date, ticker, price/lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM grid) WHERE r IS NOT NULL""",
    "monthly_return",
)
def monthly_returns(spark, sf):
    return shape.returns_long(X.grid(spark, sf))


@query(
    "padded_returns",
    f"""WITH {X.GRID},
pad AS (SELECT ticker, date, last_value(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS price FROM grid)
SELECT ticker, date, price, price/lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM pad""",
    "price ret",
)
def padded_returns(spark, sf):
    return shape.simple_returns(X.grid(spark, sf), fill="pad")


@query("dense_grid", f"WITH {X.GRID} SELECT ticker, date, price FROM grid", "price")
def dense_grid(spark, sf):
    return X.grid(spark, sf)


@query(
    "wide_panel_unpivot",
    f"""WITH px AS (SELECT last_day(CAST(l_shipdate AS DATE)) AS date, l_returnflag AS ticker, {X.DAILY_UNIT} AS price
  FROM lineitem GROUP BY 1, 2)
SELECT d.date, t.ticker, p.price FROM (SELECT DISTINCT date FROM px) d CROSS JOIN (VALUES ('A'), ('N'), ('R')) t(ticker)
LEFT JOIN px p ON p.date = d.date AND p.ticker = t.ticker""",
    "price",
)
def wide_panel_unpivot(spark, sf):
    """A wide panel (one column per return flag) read back into long form."""
    wide = (
        A.load(spark, sf, "lineitem")
        .groupBy(F.last_day(F.to_date("l_shipdate")).alias("date"))
        .pivot("l_returnflag", ["A", "N", "R"])
        .agg(A._unit_price())
    )
    return unpivot_panel(wide)


@query("features_round_trip", f"WITH {X.FEAT} SELECT ticker, date, price, ret_1m, vol_12m FROM feat", "ret_1m vol_12m")
def features_round_trip(spark, sf):
    """The feature table, written by date and read back with typed keys and pruned columns."""
    path = new_path(spark, "feature-file")
    written = X.feat(spark, sf).withColumn("ticker", F.concat(F.lit(" "), F.lower("ticker")))
    write_table(written, path, by=["date"])
    return read_features(spark, path, ["date", "ticker", "price", "ret_1m", "vol_12m"])


@query(
    "bars_round_trip",
    f"WITH {X.BARS} SELECT ticker, date, close, high, low, volume FROM bars",
    "high low",
)
def bars_round_trip(spark, sf):
    """Daily bars as four wide files, one for each field, read back as one long table."""
    bars = stage(A.daily_bars(spark, sf), "bars")
    tickers = sorted(r.ticker for r in bars.select("ticker").distinct().collect())  # columns of the wide files
    paths = {}
    for field in ("close", "high", "low", "volume"):
        paths[field] = new_path(spark, f"{field}-file")
        write_table(bars.groupBy("date").pivot("ticker", tickers).agg(F.max(field)), paths[field])
    return read_ohlcv(spark, paths).filter("close IS NOT NULL")


@query(
    "ledger_round_trip",
    """SELECT CAST(o_orderdate AS DATE) AS date, upper(trim(o_orderpriority)) AS ticker, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS final_weight,
CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 = 0 END AS regime_risk_on, CAST(NULL AS BIGINT) AS best_rank, CAST(o_orderkey AS VARCHAR) AS note FROM orders""",
    "final_weight",
)
def ledger_round_trip(spark, sf):
    """A ledger as CSV with odd text, read back by its schema: tolerant numbers and dates, a missing column, one more column. A
    ledger that is not there yet is empty."""
    schema = "date date, ticker string, final_weight double, regime_risk_on boolean, best_rank bigint"
    key = F.col("o_orderkey")
    text = A.load(spark, sf, "orders").select(
        F.to_date("o_orderdate").cast("string").alias("date"),
        F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" ")).alias("ticker"),
        F.when(key % 7 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("final_weight"),
        F.when(key % 3 == 0, (key % 2 == 0).cast("string")).otherwise("-").alias("regime_risk_on"),
        key.cast("string").alias("note"),
    )
    path = new_path(spark, "ledger-file")
    write_table(text, path, "csv")
    kinds = spark.createDataFrame([], schema).schema
    return read_ledger(spark, path, kinds).unionByName(read_or_empty(spark, path + "-none", kinds, "csv"), allowMissingColumns=True)


@query(
    "price_coverage",
    f"""WITH {X.GRID}, ask AS (SELECT ticker FROM uni UNION SELECT 'MARKET'),
agg AS (SELECT ticker, count(*) - count(price) AS missing_count, count(price) AS non_missing_count,
  min(date) FILTER (price IS NOT NULL) AS first_date, max(date) FILTER (price IS NOT NULL) AS last_date,
  arg_max(price, date) FILTER (price IS NOT NULL) AS latest_price FROM grid GROUP BY 1)
SELECT a.ticker, g.ticker IS NOT NULL AS present, missing_count, coalesce(non_missing_count, 0) AS non_missing_count,
  first_date, last_date, latest_price, coalesce(last_date = (SELECT max(date) FROM grid), false) AS has_latest_month
FROM ask a LEFT JOIN agg g ON g.ticker = a.ticker""",
    "latest_price",
)
def price_coverage(spark, sf):
    g = stage(X.grid(spark, sf), "grid")
    return shape.coverage(g, universe_keys(A.universe(spark, sf), "MARKET"))


@query(
    "filled_asof_month_end",
    f"""WITH {X.BARS},
filled AS (SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date
  ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS close FROM dgrid),
ends AS (SELECT DISTINCT ticker, last_day(date) AS date FROM dgrid)
SELECT e.ticker, e.date, f.date AS price_date, f.close FROM ends e ASOF LEFT JOIN filled f ON e.ticker = f.ticker AND e.date >= f.date""",
    "close",
)
def filled_asof_month_end(spark, sf):
    """Fill at most seven rows, then take the last daily row at or before each month end."""
    bars = stage(A.daily_bars(spark, sf).select("ticker", "date", "close"), "closes")
    g = stage(shape.bounded_fill(shape.dense_grid(bars, bars, bars, "close"), ["close"], 7), "filled")
    ends = g.select("ticker", F.last_day("date").alias("date")).distinct()
    return shape.asof_join(ends, g, ["ticker"], matched_as="price_date")


@query(
    "prices_asof_date",
    f"""WITH {X.BARS} SELECT ticker, date, close FROM bars
WHERE date = (SELECT max(date) FROM bars WHERE date <= DATE '1998-07-04')""",
    "close",
)
def prices_asof_date(spark, sf):
    import datetime as dt

    bars = A.daily_bars(spark, sf).select("ticker", "date", "close")
    return shape.prices_asof(bars, dt.date(1998, 7, 4))


@query(
    "next_price_dates",
    f"WITH {X.PX} SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM px)",
)
def next_price_dates(spark, sf):
    return shape.next_dates(A.monthly_prices(spark, sf))


@query(
    "merged_measures",
    f"""WITH {X.BARS} SELECT ticker, date, max(high) AS high, max(volume) AS volume FROM
(SELECT ticker, date, high, NULL AS volume FROM bars WHERE high > low UNION ALL SELECT ticker, date, NULL, volume FROM bars WHERE volume > 50)
GROUP BY 1, 2""",
    "high volume",
)
def merged_measures(spark, sf):
    bars = stage(A.daily_bars(spark, sf), "daily-bars")
    a = bars.filter("high > low").select("date", "ticker", "high")
    b = bars.filter("volume > 50").select("date", "ticker", "volume")
    return shape.merge_measures([a, b])


@query(
    "bars_as_rows",
    f"WITH {X.BARS} UNPIVOT (SELECT ticker, date, close, high, low, volume FROM bars) ON close, high, low, volume INTO NAME field VALUE value",
    "value",
)
def bars_as_rows(spark, sf):
    bars = A.daily_bars(spark, sf)
    return shape.unpivot_row(bars, ["close", "high", "low", "volume"], ["ticker", "date"], "field")


@query(
    "selected_field",
    f"""WITH {X.BARS} SELECT t.ticker, d.date, b.close FROM
(SELECT DISTINCT ticker FROM bars UNION SELECT 'BRAND#99') t CROSS JOIN (SELECT DISTINCT date FROM bars) d
LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = d.date""",
    "close",
)
def selected_field(spark, sf):
    """One field of a (ticker, date, field, value) table on a requested list with a ticker that has no data."""
    bars = stage(A.daily_bars(spark, sf), "daily-bars")
    long = shape.unpivot_row(bars, ["close", "high", "low", "volume"], ["ticker", "date"], "field")
    asked = universe_keys(bars.select("ticker"), "BRAND#99")
    return select_field(long, "close", asked)


@query(
    "index_to_100",
    f"""WITH {X.GRID} SELECT ticker, date, price, price/first_value(price IGNORE NULLS) OVER
(PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)*100 AS index_100 FROM grid""",
    "price index_100",
)
def index_to_100(spark, sf):
    return shape.index_to_100(X.grid(spark, sf))


@query(
    "change_over_rows",
    f"""WITH {X.BARS},
c AS (SELECT ticker, date, close, {", ".join(f"close/lag(close,{n}) OVER (PARTITION BY ticker ORDER BY date) - 1 AS chg_{n}" for n in (1, 21, 252))} FROM dgrid)
SELECT * FROM c WHERE date = (SELECT max(date) FROM dgrid)""",
    "close chg_1 chg_21 chg_252",
)
def change_over_rows(spark, sf):
    bars = stage(A.daily_bars(spark, sf).select("ticker", "date", "close"), "closes")
    return shape.change_over_rows(shape.dense_grid(bars, bars, bars, "close"), value="close")


@query(
    "compounded_index",
    f"""WITH {X.GRID},
r AS (SELECT ticker, date, price/lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM grid),
g AS (SELECT ticker, date, product(1 + coalesce(ret, 0)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS growth FROM r)
SELECT ticker, date, growth, growth/max(growth) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM g""",
    "growth drawdown",
)
def compounded_index(spark, sf):
    t = Rolling()
    r = shape.simple_returns(X.grid(spark, sf))
    g = r.withColumn("growth", t.growth(F.coalesce("ret", F.lit(0.0))))
    return g.select("ticker", "date", "growth", t.drawdown("growth").alias("drawdown"))
