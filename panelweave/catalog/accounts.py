"""Orders, holdings, valuation, ledgers and comparisons."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from ..functions.scalars import month_end
from ..operators import analogs as K, book as B, compare as Q, cross
from ..operators.construct import CASH
from ..operators.shape import with_position
from ..plans.staging import stage
from ..sources import adapters as A, ledgers as L
from . import fixtures as X
from .baskets import EVAL, final_portfolio_of, period_evaluation_of
from .registry import query

START = 1_000_000.0
OPENED, REBALANCED, VALUED = dt.date(1998, 6, 30), dt.date(1999, 6, 30), dt.date(1999, 9, 30)

# first purchase on OPENED, then a rebalance a year later
ORDERS = f"""{X.FINAL},
quote0 AS (SELECT ticker, price AS latest_price FROM grid WHERE date = (SELECT max(date) FROM grid WHERE date <= DATE '{OPENED}')),
os0 AS (SELECT f.ticker, final_weight, {START}*final_weight AS target_dollars, CASE WHEN f.ticker <> 'CASH' THEN latest_price END AS latest_price,
  CASE WHEN f.ticker = 'CASH' THEN 'HOLD_CASH' WHEN q.ticker IS NULL THEN 'MISSING_PRICE' WHEN latest_price > 0 THEN 'BUY_TO_TARGET' ELSE 'BAD_PRICE' END AS order_type
  FROM fin f LEFT JOIN quote0 q ON q.ticker = f.ticker WHERE f.date = DATE '{OPENED}'),
os1 AS (SELECT *, CASE WHEN order_type = 'BUY_TO_TARGET' THEN target_dollars/latest_price END AS target_shares FROM os0),
os2 AS (SELECT *, floor(target_shares) AS rounded_shares, CASE WHEN ticker = 'CASH' THEN target_dollars ELSE floor(target_shares)*latest_price END AS rounded_dollars FROM os1),
os AS (SELECT *, (SELECT max(date) FROM grid WHERE date <= DATE '{OPENED}') AS price_date, {START}::DOUBLE AS starting_cash,
  (SELECT coalesce(sum(rounded_dollars) FILTER (ticker <> 'CASH'), 0) FROM os2) AS invested_rounded_total,
  (SELECT coalesce(sum(target_dollars) FILTER (ticker = 'CASH'), 0) FROM os2) AS explicit_cash_target FROM os2),
sheet AS (SELECT *, greatest(starting_cash - invested_rounded_total - explicit_cash_target, 0) AS leftover_cash_from_rounding FROM os),
h0 AS (SELECT ticker, rounded_shares AS shares, latest_price AS avg_entry_price, latest_price AS last_price, rounded_shares*latest_price AS market_value, price_date AS last_price_date
  FROM sheet WHERE order_type = 'BUY_TO_TARGET' AND rounded_shares > 0
  UNION ALL SELECT 'CASH', max(explicit_cash_target + leftover_cash_from_rounding), 1.0, 1.0, max(explicit_cash_target + leftover_cash_from_rounding), max(price_date) FROM sheet),
hold AS (SELECT *, market_value/sum(market_value) OVER () AS current_weight FROM h0),
quote1 AS (SELECT ticker, price AS latest_price FROM grid WHERE date = (SELECT max(date) FROM grid WHERE date <= DATE '{REBALANCED}')),
mark0 AS (SELECT h.ticker, shares, avg_entry_price, CASE WHEN h.ticker = 'CASH' THEN 1.0 WHEN q.ticker IS NULL THEN last_price ELSE latest_price END AS last_price FROM hold h LEFT JOIN quote1 q ON q.ticker = h.ticker),
mark1 AS (SELECT *, CASE WHEN ticker = 'CASH' THEN shares ELSE shares*last_price END AS market_value FROM mark0),
mark AS (SELECT *, (SELECT max(date) FROM grid WHERE date <= DATE '{REBALANCED}') AS last_price_date, market_value/sum(market_value) OVER () AS current_weight FROM mark1),
tgt AS (SELECT ticker, final_weight FROM fin WHERE date = DATE '{REBALANCED}'),
rb0 AS (SELECT coalesce(m.ticker, t.ticker) AS ticker, coalesce(shares, 0) AS current_shares, coalesce(market_value, 0) AS current_value, coalesce(final_weight, 0) AS target_weight, (SELECT sum(market_value) FROM mark) AS portfolio_value FROM mark m FULL OUTER JOIN tgt t ON t.ticker = m.ticker),
rb1 AS (SELECT r.*, q.ticker IS NOT NULL AS listed, CASE WHEN r.ticker = 'CASH' THEN 1.0 ELSE latest_price END AS latest_price, current_value/portfolio_value AS current_weight, portfolio_value*target_weight AS target_value FROM rb0 r LEFT JOIN quote1 q ON q.ticker = r.ticker),
rb2 AS (SELECT *, target_weight - current_weight AS weight_diff, CASE WHEN ticker = 'CASH' THEN target_value WHEN latest_price > 0 THEN target_value/latest_price END AS target_shares FROM rb1),
rb3 AS (SELECT *, CASE WHEN ticker = 'CASH' THEN target_value - current_shares WHEN target_shares - current_shares > 0 THEN floor(target_shares - current_shares) ELSE ceil(target_shares - current_shares) END AS trade_shares FROM rb2),
rb AS (SELECT * EXCLUDE (listed), trade_shares*latest_price AS trade_value, CASE WHEN ticker = 'CASH' THEN 'CASH_ADJUST' WHEN NOT listed THEN 'MISSING_PRICE' WHEN target_shares IS NULL THEN 'BAD_PRICE' WHEN trade_shares > 0 THEN 'BUY' WHEN trade_shares < 0 THEN 'SELL' ELSE 'HOLD' END AS action FROM rb3),
qt AS (SELECT ticker, c.price AS current_price, p.price AS previous_close, 'ok' AS quote_status FROM grid c JOIN grid p USING (ticker) WHERE c.date = DATE '{VALUED}' AND p.date = last_day(DATE '{VALUED}' - INTERVAL 1 MONTH) AND c.price IS NOT NULL
  UNION ALL SELECT 'CASH', 1.0, 1.0, 'cash')"""


def _prices(spark, sf):
    return stage(X.grid(spark, sf), "grid")


def _final(spark, sf):
    return stage(final_portfolio_of(spark, sf), "portfolio")


def _opening(spark, sf):
    """(prices, all target weights, first order sheet)."""
    prices, weights = _prices(spark, sf), _final(spark, sf)
    sheet = B.order_sheet(weights.filter(F.col("date") == OPENED).select("ticker", "final_weight"), prices, OPENED, START)
    return prices, weights, stage(sheet, "orders")


def _holdings(spark, sf):
    prices, weights, sheet = _opening(spark, sf)
    return prices, weights, stage(B.initial_holdings(sheet), "holdings")


def _marked(spark, sf):
    prices, weights, held = _holdings(spark, sf)
    return prices, weights, stage(B.mark_to_market(held, prices, REBALANCED), "marked")


def _quotes(prices):
    """Quotes of the valuation date with the month before as previous close."""
    now = prices.filter((F.col("date") == VALUED) & F.col("price").isNotNull()).select("ticker", F.col("price").alias("current_price"))
    before = prices.filter(F.col("date") == month_end(F.add_months(F.lit(VALUED), -1))).select(
        "ticker", F.col("price").alias("previous_close")
    )
    return B.cash_quote(now.join(before, "ticker").select("ticker", "current_price", "previous_close", F.lit("ok").alias("quote_status")))


@query(
    "order_sheet", f"WITH {ORDERS} SELECT * FROM sheet",
    "final_weight target_dollars target_shares rounded_shares rounded_dollars starting_cash invested_rounded_total explicit_cash_target leftover_cash_from_rounding",
)
def order_sheet(spark, sf):
    return _opening(spark, sf)[2]


@query("initial_holdings", f"WITH {ORDERS} SELECT * FROM hold", "shares avg_entry_price market_value current_weight")
def initial_holdings(spark, sf):
    return _holdings(spark, sf)[2]


@query("marked_holdings", f"WITH {ORDERS} SELECT * FROM mark", "shares avg_entry_price market_value current_weight")
def marked_holdings(spark, sf):
    return _marked(spark, sf)[2]


@query(
    "rebalance_orders",
    f"""WITH {ORDERS} SELECT *, row_number() OVER (ORDER BY CASE action WHEN 'SELL' THEN 0 WHEN 'BUY' THEN 1 WHEN 'HOLD' THEN 2
WHEN 'CASH_ADJUST' THEN 3 WHEN 'MISSING_PRICE' THEN 4 WHEN 'BAD_PRICE' THEN 5 ELSE 9 END, ticker) AS position FROM rb""",
    "current_shares current_value target_weight portfolio_value current_weight target_value weight_diff target_shares trade_shares trade_value",
)
def rebalance_orders(spark, sf):
    prices, weights, marked = _marked(spark, sf)
    target = weights.filter(F.col("date") == REBALANCED).select("ticker", "final_weight")
    orders = B.rebalance_orders(marked, target, prices, REBALANCED)
    return with_position(orders, [B.action_position(), F.col("ticker")]).select(
        "position", "ticker", "current_shares", "current_value", "target_weight", "portfolio_value", "latest_price", "current_weight",
        "target_value", "weight_diff", "target_shares", "trade_shares", "trade_value", "action",
    )


@query(
    "rebalance_summary",
    f"""WITH {ORDERS} SELECT max(portfolio_value) AS portfolio_value, coalesce(sum(current_value) FILTER (ticker = 'CASH'), 0) AS current_cash,
coalesce(sum(trade_value) FILTER (action = 'BUY'), 0) AS total_buy_value, -coalesce(sum(trade_value) FILTER (action = 'SELL'), 0) AS total_sell_value,
count(*) FILTER (action = 'BUY') AS buy_order_count, count(*) FILTER (action = 'SELL') AS sell_order_count, count(*) FILTER (action = 'HOLD') AS hold_count,
count(*) FILTER (action = 'MISSING_PRICE') AS missing_price_count, count(*) FILTER (action = 'BAD_PRICE') AS bad_price_count,
coalesce(sum(current_value) FILTER (ticker = 'CASH'), 0) - coalesce(sum(trade_value) FILTER (action = 'SELL'), 0) - coalesce(sum(trade_value) FILTER (action = 'BUY'), 0) AS estimated_cash_after_trades FROM rb""",
    "portfolio_value current_cash total_buy_value total_sell_value estimated_cash_after_trades", 4,
)
def rebalance_summary(spark, sf):
    prices, weights, marked = _marked(spark, sf)
    target = weights.filter(F.col("date") == REBALANCED).select("ticker", "final_weight")
    return B.rebalance_summary(B.rebalance_orders(marked, target, prices, REBALANCED))


@query(
    "applied_rebalance",
    f"""WITH {ORDERS},
v AS (SELECT sum(CASE WHEN m.ticker = 'CASH' THEN shares ELSE shares*coalesce(CASE WHEN current_price > 0 THEN current_price END, CASE WHEN last_price > 0 THEN last_price END) END) AS v FROM mark m LEFT JOIN qt ON qt.ticker = m.ticker),
nb AS (SELECT t.ticker, floor(final_weight*(SELECT v FROM v)/current_price) AS shares, current_price AS avg_entry_price FROM tgt t JOIN qt ON qt.ticker = t.ticker WHERE t.ticker <> 'CASH' AND final_weight > 0 AND current_price > 0),
nh AS (SELECT ticker, shares, avg_entry_price, shares*avg_entry_price AS market_value FROM nb WHERE shares > 0),
al AS (SELECT * FROM nh UNION ALL SELECT 'CASH', c, 1.0, c FROM (SELECT greatest((SELECT v FROM v) - coalesce(sum(market_value), 0), 0) AS c FROM nh))
SELECT *, market_value/sum(market_value) OVER () AS current_weight FROM al""",
    "shares avg_entry_price market_value current_weight", 4,
)
def applied_rebalance(spark, sf):
    prices, weights, marked = _marked(spark, sf)
    target = weights.filter(F.col("date") == REBALANCED).select("ticker", "final_weight")
    return B.apply_rebalance(marked, target, _quotes(prices)).drop("last_price")


@query(
    "portfolio_value_summary",
    f"""WITH {ORDERS}, s AS (SELECT max(last_price_date) AS valuation_date, sum(market_value) AS total_value, coalesce(sum(market_value) FILTER (ticker = 'CASH'), 0) AS cash_value,
count(*) FILTER (ticker <> 'CASH') AS stock_positions, arg_min(ticker, (-market_value, ticker)) FILTER (ticker <> 'CASH' AND market_value IS NOT NULL) AS top_holding, max(market_value) FILTER (ticker <> 'CASH') AS top_holding_value FROM mark)
SELECT *, total_value - cash_value AS stock_value, cash_value/total_value AS cash_weight, top_holding_value/total_value AS top_holding_weight, total_value/{START} - 1 AS total_return FROM s""",
    "total_value cash_value top_holding_value stock_value cash_weight top_holding_weight total_return", 4,
)
def portfolio_value_summary(spark, sf):
    return B.portfolio_summary(_marked(spark, sf)[2], START)


@query(
    "sector_exposure",
    f"""WITH {ORDERS}, s AS (SELECT coalesce(sector, 'Cash/Unknown') AS sector, sum(market_value) AS market_value FROM mark LEFT JOIN uni USING (ticker) GROUP BY 1)
SELECT *, market_value/sum(market_value) OVER () AS weight FROM s""",
    "market_value weight", 4,
)
def sector_exposure(spark, sf):
    return cross.sector_exposure(_marked(spark, sf)[2], A.universe(spark, sf))


DETAIL = f"""{ORDERS},
dt0 AS (SELECT m.*, current_price, previous_close, quote_status, shares*previous_close AS previous_close_value, shares*current_price AS current_value FROM mark m LEFT JOIN qt ON qt.ticker = m.ticker),
det AS (SELECT *, current_value - previous_close_value AS day_pnl, CASE WHEN previous_close_value > 0 THEN (current_value - previous_close_value)/previous_close_value ELSE 0 END AS day_return FROM dt0)"""


@query(
    "live_valuation",
    f"""WITH {DETAIL}, s AS (SELECT coalesce(sum(previous_close_value), 0) AS previous_close_value, coalesce(sum(current_value), 0) AS current_value, coalesce(sum(current_value) FILTER (ticker = 'CASH'), 0) AS cash_value,
count(*) FILTER (ticker <> 'CASH') AS stock_positions, coalesce(arg_min(ticker, (-day_pnl, ticker)) FILTER (ticker <> 'CASH' AND day_pnl IS NOT NULL), 'NONE') AS best_ticker, coalesce(max(day_pnl) FILTER (ticker <> 'CASH'), 0) AS best_day_pnl,
coalesce(arg_min(ticker, (day_pnl, ticker)) FILTER (ticker <> 'CASH' AND day_pnl IS NOT NULL), 'NONE') AS worst_ticker, coalesce(min(day_pnl) FILTER (ticker <> 'CASH'), 0) AS worst_day_pnl, count(*) FILTER (quote_status IS NULL) AS missing_quote_count,
(SELECT price FROM bench WHERE date = DATE '{VALUED}') AS bench_current_price, (SELECT price FROM bench WHERE date = last_day(DATE '{VALUED}' - INTERVAL 1 MONTH)) AS bench_previous_close FROM det),
t AS (SELECT *, current_value - previous_close_value AS day_pnl, (current_value - previous_close_value)/previous_close_value AS day_return, cash_value/current_value AS cash_weight, bench_current_price/bench_previous_close - 1 AS bench_day_return FROM s)
SELECT *, day_return - bench_day_return AS excess_day_return, day_pnl - previous_close_value*bench_day_return AS excess_day_pnl FROM t""".replace("WITH ", f"WITH {X.BENCH}, ", 1),
    "previous_close_value current_value cash_value best_day_pnl worst_day_pnl bench_current_price bench_previous_close day_pnl day_return cash_weight bench_day_return excess_day_return excess_day_pnl", 4,
)
def live_valuation(spark, sf):
    prices, _, marked = _marked(spark, sf)
    snap = B.value_snapshot(B.value_positions(marked, _quotes(prices)))
    b = X.bench(spark, sf)
    before = month_end(F.add_months(F.lit(VALUED), -1))
    with_bench = snap.withColumn(
        "bench_current_price", b.filter(F.col("date") == VALUED).select("price").scalar()
    ).withColumn("bench_previous_close", b.filter(F.col("date") == before).select("price").scalar())
    return B.against_benchmark(with_bench)


@query(
    "positions_view",
    f"""WITH {DETAIL}, p AS (SELECT ticker, shares, avg_entry_price, coalesce(current_price, last_price) AS current_price, day_return, coalesce(current_value, shares*coalesce(current_price, last_price)) AS live_market_value FROM det)
SELECT *, CASE WHEN avg_entry_price > 0 THEN current_price/avg_entry_price - 1 END AS since_entry, live_market_value/sum(live_market_value) OVER () AS live_weight FROM p""",
    "shares avg_entry_price current_price day_return live_market_value since_entry live_weight", 4,
)
def positions_view(spark, sf):
    prices, _, marked = _marked(spark, sf)
    detail = B.value_positions(marked, _quotes(prices))
    return B.positions_view(marked, detail).select(
        "ticker", "shares", "avg_entry_price", "current_price", "day_return", "live_market_value", "since_entry", "live_weight"
    )


# the value of the opening book on every month end from then on
VALUES = f"""{X.BENCH}, {ORDERS},
vals AS (SELECT g.date AS valuation_date, sum(CASE WHEN h.ticker = 'CASH' THEN shares ELSE shares*g.price END) AS total_value FROM (SELECT ticker, date, price FROM grid UNION ALL SELECT 'CASH', date, 1.0 FROM (SELECT DISTINCT date FROM grid)) g
  JOIN hold h ON h.ticker = g.ticker WHERE g.date >= DATE '{OPENED}' GROUP BY 1)"""


def _value_history(spark, sf):
    prices, _, held = _holdings(spark, sf)
    calendar = prices.select("date").distinct().select("date", F.lit(CASH).alias("ticker"), F.lit(1.0).alias("price"))
    q = prices.unionByName(calendar).filter(F.col("date") >= OPENED)
    return q.join(held.select("ticker", "shares"), "ticker").groupBy(F.col("date").alias("valuation_date")).agg(
        F.sum(F.col("shares") * F.col("price")).alias("total_value")
    )


@query(
    "inception_benchmark",
    f"""WITH {VALUES}, a AS (SELECT price FROM bench WHERE date = (SELECT max(date) FROM bench WHERE date <= DATE '{OPENED}'))
SELECT valuation_date, total_value AS current_value, b.price AS bench_current_price, {START}*b.price/(SELECT price FROM a) AS bench_equivalent_value, b.price/(SELECT price FROM a) - 1 AS bench_cum_return,
total_value/{START} - 1 - (b.price/(SELECT price FROM a) - 1) AS excess_cum_return, total_value - {START}*b.price/(SELECT price FROM a) AS excess_cum_pnl FROM vals LEFT JOIN bench b ON b.date = valuation_date""",
    "current_value bench_current_price bench_equivalent_value bench_cum_return excess_cum_return excess_cum_pnl", 4,
)
def inception_benchmark(spark, sf):
    b = X.bench(spark, sf)
    anchor = B.inception_anchor(b, OPENED, START)
    values = _value_history(spark, sf).withColumnRenamed("total_value", "current_value")
    snaps = values.join(
        b.select(F.col("date").alias("valuation_date"), F.col("price").alias("bench_current_price")), "valuation_date", "left"
    )
    return B.against_anchor(snaps, anchor)


@query(
    "buy_and_hold_benchmark",
    f"""WITH {VALUES}, t AS (SELECT valuation_date, total_value, total_value/{START} - 1 AS total_return FROM vals),
s AS (SELECT arg_max(price, date) AS p FROM bench WHERE date <= (SELECT min(valuation_date) FROM t))
SELECT t.*, b.price/(SELECT p FROM s) - 1 AS bench_total_return, {START}*(b.price/(SELECT p FROM s)) AS bench_value, total_value - {START}*(b.price/(SELECT p FROM s)) AS excess_value, total_return - (b.price/(SELECT p FROM s) - 1) AS excess_return
FROM t ASOF LEFT JOIN bench b ON t.valuation_date >= b.date""",
    "total_value total_return bench_total_return bench_value excess_value excess_return", 4,
)
def buy_and_hold_benchmark(spark, sf):
    values = _value_history(spark, sf).withColumn("total_return", F.col("total_value") / START - 1.0)
    return B.buy_and_hold(values, X.bench(spark, sf), START)


# two signals of the newest date: 6-month and 12-month momentum
SIGNALS = f"""{X.FEAT}, {X.basket_sql('sa', 'ret_6m', 20)}, {X.basket_sql('sb', 'ret_12m', 20)},
a AS (SELECT ticker, branch_inner_weight AS w FROM sa WHERE date = (SELECT max(date) FROM sa)), b AS (SELECT ticker, branch_inner_weight AS w FROM sb WHERE date = (SELECT max(date) FROM sb)),
sd AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.w, 0) AS a_weight, coalesce(b.w, 0) AS b_weight FROM a FULL OUTER JOIN b ON b.ticker = a.ticker),
sdf AS (SELECT *, a_weight > 0 AS in_a, b_weight > 0 AS in_b, a_weight > 0 AND b_weight > 0 AS in_both, b_weight - a_weight AS weight_diff, abs(b_weight - a_weight) AS abs_weight_diff FROM sd)"""


def _two_signals(spark, sf, more=()):
    f = stage(X.feat(spark, sf), "features")
    sides = []
    for score in ("ret_6m", "ret_12m"):
        book = stage(X.book(f, score, 20), "book")
        newest = L.latest_partition(book, "date").withColumn("model_name", F.lit(score))
        named = [F.col(c).alias({"date": "signal_date"}.get(c, c)) for c in more]
        sides.append(newest.select("ticker", F.col("weight").alias("final_weight"), *named))
    return sides


@query("signal_diff", f"WITH {SIGNALS} SELECT * FROM sdf", "a_weight b_weight weight_diff abs_weight_diff")
def signal_diff(spark, sf):
    return Q.signal_diff(*_two_signals(spark, sf))


@query(
    "signal_diff_summary",
    f"""WITH {SIGNALS} SELECT count(*) FILTER (in_a) AS a_count, count(*) FILTER (in_b) AS b_count, count(*) FILTER (in_both) AS overlap_count, count(*) FILTER (in_a AND NOT in_b) AS only_a_count,
count(*) FILTER (in_b AND NOT in_a) AS only_b_count, corr(a_weight, b_weight) AS weight_correlation, sum(abs_weight_diff) AS total_abs_weight_diff, 0.0::DOUBLE AS a_cash_weight, 0.0::DOUBLE AS b_cash_weight,
count(*) FILTER (in_both)/count(*) FILTER (in_a)::DOUBLE AS overlap_share_of_a, count(*) FILTER (in_both)/count(*) FILTER (in_b)::DOUBLE AS overlap_share_of_b FROM sdf""",
    "weight_correlation total_abs_weight_diff a_cash_weight b_cash_weight overlap_share_of_a overlap_share_of_b",
)
def signal_diff_summary(spark, sf):
    return Q.signal_diff_summary(Q.signal_diff(*_two_signals(spark, sf)))


_IN = "string_agg(ticker, ', ' ORDER BY ticker) FILTER"
_TOP = "(SELECT string_agg(ticker, ', ' ORDER BY r) FROM (SELECT ticker, row_number() OVER (ORDER BY w DESC, ticker) AS r FROM {0} QUALIFY r <= 10))"


@query(
    "signal_lists",
    f"""WITH {SIGNALS} SELECT (SELECT max(date) FROM sa) AS a_signal_date, (SELECT max(date) FROM sb) AS b_signal_date, 'ret_6m' AS a_model_name, 'ret_12m' AS b_model_name,
coalesce({_IN} (in_both), '') AS overlap_tickers, coalesce({_IN} (in_a AND NOT in_b), '') AS only_a_tickers, coalesce({_IN} (in_b AND NOT in_a), '') AS only_b_tickers,
{_TOP.format('a')} AS a_top_tickers, {_TOP.format('b')} AS b_top_tickers FROM sdf""",
)
def signal_lists(spark, sf):
    """Dates, models and tickers of the two signals that ``signal_diff_summary`` counts."""
    return Q.signal_lists(*_two_signals(spark, sf, ("date", "model_name")))


@query(
    "branch_overlap",
    f"""WITH {SIGNALS}, m AS (SELECT ticker, CASE WHEN in_both THEN 'overlap' WHEN in_a THEN 'only_a' ELSE 'only_b' END AS membership FROM sdf)
SELECT membership, count(*) AS names, string_agg(ticker, ', ' ORDER BY ticker) AS tickers FROM m GROUP BY 1""",
)
def branch_overlap(spark, sf):
    members = cross.membership(*_two_signals(spark, sf))
    # two baskets of twenty names each: the lists are bounded
    return members.groupBy("membership").agg(
        F.count(F.lit(1)).alias("names"), F.array_join(F.array_sort(F.collect_list("ticker")), ", ").alias("tickers")
    )


@query(
    "common_dates",
    f"WITH {X.PX}, {X.BENCH} SELECT DISTINCT date FROM px WHERE date IN (SELECT date FROM bench)",
)
def common_dates(spark, sf):
    return cross.common_dates([A.monthly_prices(spark, sf), X.bench(spark, sf)])


@query(
    "regime_members",
    f"WITH {X.PX}, {X.UNI} SELECT ticker, date, price FROM px WHERE ticker IN (SELECT ticker FROM uni WHERE sector = '{X.SECTOR}')",
    "price",
)
def regime_members(spark, sf):
    return cross.keep_members(
        A.monthly_prices(spark, sf), A.universe(spark, sf).filter(F.col("sector") == X.SECTOR), ["ticker"]
    )


NET = f"""{X.PX}, netpx AS (SELECT 'S'||l_suppkey AS ticker, last_day(CAST(l_shipdate AS DATE)) AS date,
CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)*(100 - CAST(round(l_discount*100) AS BIGINT))) AS DOUBLE)/CAST(10000*sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS price FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2)"""
DIFF = f"""{NET}, j AS (SELECT p.ticker, p.date, p.price AS a, n.price AS b, abs((n.price - p.price)/p.price) AS d FROM px p JOIN netpx n ON n.ticker = p.ticker AND n.date = p.date),
cm AS (SELECT DISTINCT date FROM px INTERSECT SELECT DISTINCT date FROM netpx),
sa AS (SELECT ticker, min(date) AS a_first_date, max(date) AS a_last_date FROM px WHERE date IN (SELECT date FROM cm) GROUP BY 1),
sb AS (SELECT ticker, min(date) AS b_first_date, max(date) AS b_last_date FROM netpx WHERE date IN (SELECT date FROM cm) GROUP BY 1),
st AS (SELECT ticker, count(*) AS overlap_count, avg(d) AS mean_abs_pct_diff, median(d) AS median_abs_pct_diff, max(d) AS max_abs_pct_diff, arg_max(a, date) AS latest_a_price, arg_max(b, date) AS latest_b_price, arg_max(d, date) AS latest_abs_pct_diff FROM j GROUP BY 1),
ct AS (SELECT ticker FROM px INTERSECT SELECT ticker FROM netpx),
diff AS (SELECT ct.ticker, a_first_date, a_last_date, b_first_date, b_last_date, st.* EXCLUDE (ticker) REPLACE (coalesce(overlap_count, 0) AS overlap_count)
FROM ct LEFT JOIN st ON st.ticker = ct.ticker LEFT JOIN sa ON sa.ticker = st.ticker LEFT JOIN sb ON sb.ticker = st.ticker)"""
DIFF_DOUBLES = "mean_abs_pct_diff median_abs_pct_diff max_abs_pct_diff latest_a_price latest_b_price latest_abs_pct_diff"


def _price_sources(spark, sf):
    return stage(A.monthly_prices(spark, sf), "prices-a"), stage(A.net_prices(spark, sf), "prices-b")


@query("price_source_diff", f"WITH {DIFF} SELECT * FROM diff", DIFF_DOUBLES, 5)
def price_source_diff(spark, sf):
    return Q.price_diff(*_price_sources(spark, sf))


@query("large_price_diffs", f"WITH {DIFF} SELECT ticker, latest_abs_pct_diff FROM diff WHERE latest_abs_pct_diff > 0.05", "latest_abs_pct_diff")
def large_price_diffs(spark, sf):
    return Q.large_diffs(Q.price_diff(*_price_sources(spark, sf))).select("ticker", "latest_abs_pct_diff")


@query(
    "one_sided_prices",
    f"""WITH {NET} SELECT ticker, date, 'a' AS side FROM (SELECT ticker, date FROM px EXCEPT SELECT ticker, date FROM netpx)
UNION ALL SELECT ticker, date, 'b' FROM (SELECT ticker, date FROM netpx EXCEPT SELECT ticker, date FROM px)""",
)
def one_sided_prices(spark, sf):
    return Q.one_sided(*_price_sources(spark, sf), ["ticker", "date"])


@query(
    "schema_diff",
    f"""WITH {X.GRID}, {X.BARS} SELECT * FROM (VALUES ('ticker', true, true, 'string', 'string', 0.0::DOUBLE, 0.0::DOUBLE), ('date', true, true, 'date', 'date', 0.0, 0.0),
('close', false, true, NULL, 'double', NULL, 0.0), ('high', false, true, NULL, 'double', NULL, 0.0), ('low', false, true, NULL, 'double', NULL, 0.0), ('volume', false, true, NULL, 'double', NULL, 0.0)) t("column", in_a, in_b, a_type, b_type, a_missing_share, b_missing_share)
UNION ALL SELECT 'price', true, false, 'double', NULL, 1 - count(price)/count(*)::DOUBLE, NULL FROM grid""",
    "a_missing_share b_missing_share",
)
def schema_diff(spark, sf):
    return Q.schema_diff(X.grid(spark, sf), A.daily_bars(spark, sf))


OWN_FEATURES = ["ret_1m", "ret_3m", "ret_6m", "ret_12m", "vol_12m", "stock_drawdown", "future_1m_return"]
NEIGHBOR_FEATURES = [
    "neighbor_count", "neighbor_avg_future_1m_return", "neighbor_avg_future_1m_excess_return", "neighbor_outperform_1m_rate",
    "neighbor_positive_1m_return_rate",
]
VALUE_FEATURES = OWN_FEATURES + NEIGHBOR_FEATURES
STATE = ["ret_1m", "ret_6m", "vol_12m"]  # the space in which the analogs of this comparison are sought


def _near_on(name: str) -> str:
    """The feature table of ``name`` on the newest common date with the statistics of its analogs."""
    return f"""{name}_z AS (SELECT f.*, [{", ".join(STATE)}] AS z, f.future_1m_return - bx.r AS ex FROM {name}_feat f LEFT JOIN bx ON bx.date = f.date),
{name}_nn AS (SELECT q.ticker, round(list_distance(q.z, h.z), 9) AS d, h.future_1m_return AS o, h.ex, row_number() OVER (PARTITION BY q.ticker ORDER BY round(list_distance(q.z, h.z), 9), h.date, h.ticker) AS i
  FROM {name}_z q JOIN {name}_z h ON h.date < q.date WHERE q.date = (SELECT d FROM nd) AND h.future_1m_return IS NOT NULL AND {" AND ".join(f"{s}.{c} IS NOT NULL" for s in "qh" for c in STATE)}
  AND (SELECT count(*) FROM {name}_z WHERE date < (SELECT d FROM nd) AND future_1m_return IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in STATE)}) >= 250 QUALIFY i <= 50),
{name}_st AS (SELECT ticker, count(*) AS n, avg(o) AS ao, avg(ex) AS ae, avg(coalesce(ex > 0, false)::INT) AS pe, avg((o > 0)::INT) AS po FROM {name}_nn GROUP BY 1),
{name}_w AS (SELECT z.*, coalesce(n, 0)::DOUBLE AS neighbor_count, ao AS neighbor_avg_future_1m_return, ae AS neighbor_avg_future_1m_excess_return, pe AS neighbor_outperform_1m_rate, po AS neighbor_positive_1m_return_rate
  FROM {name}_z z LEFT JOIN {name}_st s ON s.ticker = z.ticker WHERE z.date = (SELECT d FROM nd))"""


def _feat_on(px: str, name: str) -> str:
    """The feature CTEs over another price table."""
    body = X.FEAT[X.FEAT.index("grid AS"):]
    for cte in ("grid", "f1", "feat"):
        body = body.replace(f"{cte} AS (", f"{name}_{cte} AS (").replace(f"FROM {cte})", f"FROM {name}_{cte})")
    return body.replace("JOIN px p", f"JOIN {px} p").replace("date FROM px)", f"date FROM {px})")


@query(
    "feature_value_diff",
    f"""WITH {NET}, {X.UNI}, {_feat_on('px', 'a')}, {_feat_on('netpx', 'b')},
nd AS (SELECT max(date) AS d FROM (SELECT date FROM a_feat INTERSECT SELECT date FROM b_feat)),
{X.BENCH}, bx AS (SELECT date, lead(price) OVER (ORDER BY date)/price - 1 AS r FROM bench), {_near_on('a')}, {_near_on('b')},
j AS (SELECT {", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in VALUE_FEATURES)} FROM a_w a JOIN b_w b ON b.ticker = a.ticker)
""" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(b_{c} - a_{c}) AS overlap_count, avg(abs(b_{c} - a_{c})) AS mean_abs_diff, max(abs(b_{c} - a_{c})) AS max_abs_diff, "
        f"1 - count(a_{c})/count(*)::DOUBLE AS a_missing_share, 1 - count(b_{c})/count(*)::DOUBLE AS b_missing_share, median(abs(b_{c} - a_{c})) AS median_abs_diff, (SELECT d FROM nd) AS comparison_date FROM j"
        for c in VALUE_FEATURES
    ),
    "mean_abs_diff max_abs_diff a_missing_share b_missing_share median_abs_diff",
)
def feature_value_diff(spark, sf):
    from ..operators.features import stock_features
    from ..operators.shape import dense_grid

    u, bench = A.universe(spark, sf), X.bench(spark, sf)
    following = Window.orderBy("date")  # one row per date
    bench = stage(bench.select("date", (F.lead("price").over(following) / F.col("price") - 1.0).alias("_r")), "bench-returns")
    tables = [stage(stock_features(dense_grid(p, u, p)), "features") for p in _price_sources(spark, sf)]
    newest = tables[0].select("date").intersect(tables[1].select("date")).select(F.max("date").alias("date"))
    both = []
    for f in tables:
        rows = f.join(bench, "date", "left").select(
            "ticker", "date", F.array(*STATE).alias("z"), "future_1m_return", (F.col("future_1m_return") - F.col("_r")).alias("future_1m_excess_return")
        )
        near = K.neighbor_stats(rows, K.nearest_earlier(rows, only=newest)).withColumn("neighbor_count", F.col("neighbor_count").cast("double"))
        both.append(stage(f.join(near.select("ticker", "date", *NEIGHBOR_FEATURES), ["ticker", "date"], "left"), "features"))
    return Q.value_diff(*both, VALUE_FEATURES)


@query(
    "freshness",
    f"""WITH {X.PX}, d AS (SELECT max(date) AS p, (SELECT max(last_day(CAST(o_orderdate AS DATE))) FROM orders) AS s, (SELECT max(CAST(ts AS DATE)) FROM events) AS n FROM px)
SELECT p AS prices_date, p AS base_date, n AS neighbors_date, s AS signals_date, date_diff('day', p, DATE '2002-02-01') AS stale_days, 0::BIGINT AS issue_count,
CAST((n < p)::INT + (s < n)::INT + (s < p)::INT + (date_diff('day', p, DATE '2002-02-01') > 45)::INT AS BIGINT) AS warning_count, true AS ready,
concat_ws('; ', CASE WHEN n < p THEN 'neighbors behind prices' END, CASE WHEN s < n THEN 'signals behind neighbors' END, CASE WHEN s < p THEN 'signals behind prices' END, CASE WHEN date_diff('day', p, DATE '2002-02-01') > 45 THEN 'prices stale' END) AS warnings FROM d""",
)
def freshness(spark, sf):
    prices = A.monthly_prices(spark, sf)
    signals = A.load(spark, sf, "orders").select(F.last_day(F.to_date("o_orderdate")).alias("date"), F.col("o_custkey").alias("ticker"))
    near = A.load(spark, sf, "events").select(F.to_date("ts").alias("date"), F.col("user_id").alias("ticker"))
    tables = {"prices": prices, "base": prices, "neighbors": near, "signals": signals}
    return Q.freshness(tables, dt.date(2002, 2, 1))


LEDGER = f"""{X.FEAT}, {X.basket_sql('sa', 'ret_6m', 10)}, {X.basket_sql('sb', 'ret_12m', 10)},
old AS (SELECT 'm1' AS model_name, date AS signal_date, ticker, branch_inner_weight AS final_weight FROM sa),
new AS (SELECT 'm1' AS model_name, date AS signal_date, ticker, branch_inner_weight AS final_weight, 'rerun' AS source FROM sb WHERE year(date) >= 2000)"""


def _ledger(spark, sf):
    f = stage(X.feat(spark, sf), "features")

    def rows(score):
        return X.book(f, score, 10).select(
            F.lit("m1").alias("model_name"), F.col("date").alias("signal_date"), "ticker", F.col("weight").alias("final_weight")
        )

    new = rows("ret_12m").filter(F.year("signal_date") >= 2000).withColumn("source", F.lit("rerun"))
    return stage(rows("ret_6m"), "ledger"), stage(new, "ledger-new")


@query(
    "ledger_upsert",
    f"""WITH {LEDGER} SELECT model_name, signal_date, ticker, final_weight, NULL AS source FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.model_name = o.model_name AND n.signal_date = o.signal_date)
UNION ALL SELECT * FROM new""",
    "final_weight",
)
def ledger_upsert(spark, sf):
    old, new = _ledger(spark, sf)
    once = L.rewrite(spark, L.upsert(old, new, ["model_name", "signal_date"]), "ledger")
    return L.upsert(once, new, ["model_name", "signal_date"])  # a second time: nothing changes


@query(
    "ledger_latest", f"WITH {LEDGER} SELECT * FROM old WHERE signal_date = (SELECT max(signal_date) FROM old)", "final_weight",
)
def ledger_latest(spark, sf):
    old, _ = _ledger(spark, sf)
    return L.latest_partition(old, "signal_date", F.col("model_name") == "m1")


@query(
    "latest_price_rows",
    f"WITH {X.PX} SELECT ticker, max(date) AS date, arg_max(price, date) AS price FROM px GROUP BY 1", "price",
)
def latest_price_rows(spark, sf):
    return L.latest_row(A.monthly_prices(spark, sf), ["ticker"], "date").select("ticker", "date", "price")


@query(
    "pending_dates",
    f"WITH {X.PX}, {X.BENCH} SELECT date FROM bench EXCEPT SELECT last_day(CAST(o_orderdate AS DATE)) FROM orders",
)
def pending_dates(spark, sf):
    done = A.load(spark, sf, "orders").select(month_end("o_orderdate").alias("date"))
    return L.pending(X.bench(spark, sf).select("date"), done)


@query(
    "snapshot_upsert",
    f"""WITH {VALUES}, o AS (SELECT valuation_date, total_value FROM vals), n AS (SELECT valuation_date, total_value*1.01 AS total_value FROM vals WHERE year(valuation_date) = 2000)
SELECT * FROM o WHERE valuation_date NOT IN (SELECT valuation_date FROM n) UNION ALL SELECT * FROM n""",
    "total_value", 4,
)
def snapshot_upsert(spark, sf):
    from ..plans.staging import new_path

    values = stage(_value_history(spark, sf), "values")
    path = new_path(spark, "snapshots")
    L.upsert_partitions(values, path, ["valuation_date"])
    redo = values.filter(F.year("valuation_date") == 2000).withColumn("total_value", F.col("total_value") * 1.01)
    L.upsert_partitions(redo, path, ["valuation_date"])
    return spark.read.parquet(path).select("valuation_date", "total_value")


@query(
    "performance_upsert",
    f"""WITH {EVAL}, m AS (SELECT model_name, signal_date, CASE WHEN year(signal_date) >= 2000 THEN portfolio_return/2 ELSE portfolio_return END AS portfolio_return, bench_return FROM perf),
c AS (SELECT *, 1000*product(1+portfolio_return) OVER w AS portfolio_value, 1000*product(1+bench_return) OVER w AS bench_value FROM m WINDOW w AS (PARTITION BY model_name ORDER BY signal_date ROWS UNBOUNDED PRECEDING))
SELECT model_name, signal_date, portfolio_return, portfolio_value/1000 - 1 AS portfolio_cum_return, bench_value/1000 - 1 AS bench_cum_return FROM c""",
    "portfolio_return portfolio_cum_return bench_cum_return",
)
def performance_upsert(spark, sf):
    """Later periods replaced, then all cumulative columns recomputed."""
    from ..operators.perf import cumulative

    old = stage(period_evaluation_of(spark, sf).select("model_name", "signal_date", "portfolio_return", "bench_return"), "performance")
    new = old.filter(F.year("signal_date") >= 2000).withColumn("portfolio_return", F.col("portfolio_return") / 2)
    merged = L.upsert(old, new, ["model_name", "signal_date"])
    return cumulative(merged, 1000.0).select(
        "model_name", "signal_date", "portfolio_return", "portfolio_cum_return", "bench_cum_return"
    )
