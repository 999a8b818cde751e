"""Feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.feature_names import feature_columns
from ..operators import cross, extras, features as feats, medians, ranks, states
from ..operators.shape import by_ticker, dense_grid
from ..plans.staging import new_path, stage
from ..sources import adapters as A
from ..sources.tables import normalize_universe
from . import fixtures as X
from .registry import query

TRAILING = (
    "price ret_1m ret_3m ret_6m ret_12m price_ma_3m price_ma_6m price_ma_12m stock_drawdown_6m stock_drawdown_12m "
    "stock_drawdown price_to_ma_3m price_to_ma_6m price_to_ma_12m vol_3m vol_6m vol_12m future_1m_return"
)
RETS = [f"ret_{n}m" for n in (1, 3, 6, 12)]


@query("trailing_features", f"WITH {X.FEAT} SELECT * FROM feat", TRAILING)
def trailing_features(spark, sf):
    return X.feat(spark, sf)


@query(
    "forward_labels",
    f"""WITH {X.LABELLED} SELECT ticker, date, future_1m_return, future_1m_bench_return, future_1m_excess_return,
target_outperform_1m FROM lab""",
    "future_1m_return future_1m_bench_return future_1m_excess_return target_outperform_1m",
)
def forward_labels(spark, sf):
    return X.labelled(spark, sf).select(
        "ticker", "date", "future_1m_return", "future_1m_bench_return", "future_1m_excess_return", "target_outperform_1m"
    )


@query(
    "benchmark_features", f"WITH {X.BENCHF} SELECT * FROM bf",
    "bench_price bench_ret_1m bench_ret_3m bench_ret_6m bench_ret_12m bench_vol_3m bench_vol_6m bench_vol_12m "
    "bench_drawdown future_1m_bench_return",
)
def benchmark_features(spark, sf):
    return feats.benchmark_features(X.bench(spark, sf))


@query(
    "sector_relative",
    f"""WITH {X.LABELLED} SELECT ticker, date, sector, {", ".join(f"avg({c}) OVER (PARTITION BY date, sector) AS sector_{c}" for c in RETS)},
{", ".join(f"{c} - avg({c}) OVER (PARTITION BY date, sector) AS {c}_minus_sector" for c in RETS)} FROM lab""",
    " ".join(f"sector_{c} {c}_minus_sector" for c in RETS),
)
def sector_relative(spark, sf):
    f = stage(X.feat(spark, sf).join(A.universe(spark, sf), "ticker", "left"), "features")
    out = feats.sector_features(f)
    return out.select("ticker", "date", "sector", *[f"sector_{c}" for c in RETS], *[f"{c}_minus_sector" for c in RETS])


@query(
    "sector_indicators",
    f"""WITH {X.UNI} SELECT ticker, sector, {", ".join(f"CAST(sector = '{v}' AS BIGINT) AS \"sector_{v}\"" for v in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))} FROM uni""",
)
def sector_indicators(spark, sf):
    return feats.indicator_columns(A.universe(spark, sf).select("ticker", "sector"), ["sector"])


@query(
    "return_fifths",
    f"""WITH {X.FEAT} SELECT ticker, date, future_1m_return, CAST(CASE WHEN s <= 0.2 THEN 0 WHEN s <= 0.4 THEN 1 WHEN s <= 0.6 THEN 2
WHEN s <= 0.8 THEN 3 ELSE 4 END AS BIGINT) AS ranking_label FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY future_1m_return, ticker)
::DOUBLE / count(*) OVER (PARTITION BY date) AS s FROM feat WHERE future_1m_return IS NOT NULL)""",
    "future_1m_return",
)
def return_fifths(spark, sf):
    return ranks.fifths(X.feat(spark, sf).select("ticker", "date", "future_1m_return"))


@query(
    "score_ranks",
    f"""WITH {X.FEAT} SELECT ticker, date, ret_6m AS ranker_score, row_number() OVER (PARTITION BY date ORDER BY ret_6m DESC, ticker) AS rank_by_date
FROM feat WHERE ret_6m IS NOT NULL""",
    "ranker_score",
)
def score_ranks(spark, sf):
    f = X.feat(spark, sf).filter("ret_6m is not null")
    return ranks.score_rank(f.select("ticker", "date", F.col("ret_6m").alias("ranker_score")))


@query(
    "score_ranks_split",
    f"""WITH {X.FEAT} SELECT ticker, date, ret_6m AS ranker_score, row_number() OVER (PARTITION BY date ORDER BY ret_6m DESC, ticker) AS rank_by_date
FROM feat WHERE ret_6m IS NOT NULL""",
    "ranker_score",
)
def score_ranks_split(spark, sf):
    """The same ranks by the range-split path that large cross-sections take."""
    f = X.feat(spark, sf).filter("ret_6m is not null")
    return ranks.score_rank(f.select("ticker", "date", F.col("ret_6m").alias("ranker_score")), task_rows=25)


_D = "OVER (PARTITION BY ticker ORDER BY date)"


@query(
    "liquidity_features",
    f"""WITH {X.DRET}, q AS (SELECT *, close*volume AS dv, abs(dret)/nullif(close*volume,0) AS impact FROM dret)
SELECT ticker, date, ln(CASE WHEN m < 1 THEN 1.0 ELSE m END) AS v3_log_dollar_vol_1m, v3_volume_ratio_3m_12m, v3_amihud_3m FROM (
SELECT ticker, date, {X.roll('avg', 'dv', 21)} AS m, ({X.roll('avg', 'volume', 63)})/({X.roll('avg', 'volume', 252)}) AS v3_volume_ratio_3m_12m,
({X.roll('avg', 'impact', 63, 40)})*1e9 AS v3_amihud_3m FROM q)""",
    "v3_log_dollar_vol_1m v3_volume_ratio_3m_12m v3_amihud_3m",
)
def liquidity_features(spark, sf):
    return feats.liquidity_features(feats.daily_returns(X.daily(spark, sf)))


@query(
    "range_volatility",
    f"""WITH {X.DRET}, q AS (SELECT *, pow(ln(CASE WHEN high/low < 1 THEN 1.0 ELSE high/low END), 2) AS hl2, CASE WHEN dret < 0 THEN dret END AS down FROM dret)
SELECT ticker, date, sqrt(({X.roll('avg', 'hl2', 21)})/(4*ln(2)))*sqrt(252) AS v3_parkinson_vol_1m,
sqrt(({X.roll('avg', 'hl2', 63)})/(4*ln(2)))*sqrt(252) AS v3_parkinson_vol_3m,
(({X.roll('max', 'high', 21)}) - ({X.roll('min', 'low', 21)}))/close AS v3_intramonth_range,
({X.roll('stddev_samp', 'down', 63, 20)})*sqrt(252) AS v3_downside_vol_3m FROM q""",
    "v3_parkinson_vol_1m v3_parkinson_vol_3m v3_intramonth_range v3_downside_vol_3m",
)
def range_volatility(spark, sf):
    return feats.range_features(feats.daily_returns(X.daily(spark, sf)))


@query(
    "return_shape",
    f"""WITH {X.DRET} SELECT ticker, date, {X.roll('skewness', 'dret', 63, 40)} AS v3_ret_skew_3m,
{X.roll('kurtosis', 'dret', 63, 40)} AS v3_ret_kurt_3m, {X.roll('max', 'dret', 21)} AS v3_max_daily_ret_1m,
{X.roll('min', 'dret', 21)} AS v3_min_daily_ret_1m FROM dret""",
    "v3_ret_skew_3m v3_ret_kurt_3m v3_max_daily_ret_1m v3_min_daily_ret_1m",
)
def return_shape(spark, sf):
    return feats.shape_features(feats.daily_returns(X.daily(spark, sf)))


@query(
    "price_position",
    f"""WITH {X.DRET} SELECT ticker, date, close/({X.roll('max', 'close', 252)}) - 1 AS v3_pct_from_52w_high,
close/({X.roll('min', 'close', 252)}) - 1 AS v3_pct_from_52w_low, close/({X.roll('avg', 'close', 50)}) AS v3_price_to_ma50,
close/({X.roll('avg', 'close', 200)}) AS v3_price_to_ma200, ({X.roll('avg', 'close', 50)})/({X.roll('avg', 'close', 200)}) AS v3_ma50_over_ma200 FROM dret""",
    "v3_pct_from_52w_high v3_pct_from_52w_low v3_price_to_ma50 v3_price_to_ma200 v3_ma50_over_ma200",
)
def price_position(spark, sf):
    return feats.position_features(feats.daily_returns(X.daily(spark, sf)))


_MKT = f"""mkt AS (SELECT CAST(l_shipdate AS DATE) AS date, {X.DAILY_UNIT} AS p FROM lineitem GROUP BY 1),
mret AS (SELECT date, p/lag(p) OVER (ORDER BY date) - 1 AS bench_dret FROM mkt)"""


def _daily_market(spark, sf):
    p = (
        A.load(spark, sf, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("date"))
        .agg(A._unit_price().alias("bench_price"))
    )
    return feats.benchmark_features(p.withColumnRenamed("bench_price", "price")).select(
        "date", F.col("bench_ret_1m").alias("bench_dret")
    )


@query(
    "market_beta",
    f"""WITH {X.DRET}, {_MKT}, j AS (SELECT d.*, bench_dret FROM dret d LEFT JOIN mret m ON m.date = d.date),
b AS (SELECT *, ({X.roll('covar_samp', 'dret,bench_dret', 252)})/({X.roll('var_samp', 'bench_dret', 252)}) AS beta,
{X.roll('corr', 'dret,bench_dret', 126)} AS corr FROM j),
r AS (SELECT *, dret - beta*bench_dret AS resid FROM b)
SELECT ticker, date, beta AS v3_beta_12m, corr AS v3_corr_6m, ({X.roll('stddev_samp', 'resid', 126, 60)})*sqrt(252) AS v3_idio_vol_6m FROM r""",
    "v3_beta_12m v3_corr_6m v3_idio_vol_6m",
)
def market_beta(spark, sf):
    return feats.market_features(feats.daily_returns(X.daily(spark, sf)), _daily_market(spark, sf))


_DAILY = {
    "v3_log_dollar_vol_1m": f"ln(CASE WHEN ({X.roll('avg', 'dv', 21)}) < 1 THEN 1.0 ELSE ({X.roll('avg', 'dv', 21)}) END)",
    "v3_volume_ratio_3m_12m": f"({X.roll('avg', 'volume', 63)})/({X.roll('avg', 'volume', 252)})",
    "v3_amihud_3m": f"({X.roll('avg', 'impact', 63, 40)})*1e9",
    "v3_parkinson_vol_1m": f"sqrt(({X.roll('avg', 'hl2', 21)})/(4*ln(2)))*sqrt(252)",
    "v3_parkinson_vol_3m": f"sqrt(({X.roll('avg', 'hl2', 63)})/(4*ln(2)))*sqrt(252)",
    "v3_intramonth_range": f"(({X.roll('max', 'high', 21)}) - ({X.roll('min', 'low', 21)}))/close",
    "v3_downside_vol_3m": f"({X.roll('stddev_samp', 'down', 63, 20)})*sqrt(252)",
    "v3_ret_skew_3m": X.roll("skewness", "dret", 63, 40),
    "v3_ret_kurt_3m": X.roll("kurtosis", "dret", 63, 40),
    "v3_max_daily_ret_1m": X.roll("max", "dret", 21),
    "v3_min_daily_ret_1m": X.roll("min", "dret", 21),
    "v3_pct_from_52w_high": f"close/({X.roll('max', 'close', 252)}) - 1",
    "v3_pct_from_52w_low": f"close/({X.roll('min', 'close', 252)}) - 1",
    "v3_price_to_ma50": f"close/({X.roll('avg', 'close', 50)})",
    "v3_price_to_ma200": f"close/({X.roll('avg', 'close', 200)})",
    "v3_ma50_over_ma200": f"({X.roll('avg', 'close', 50)})/({X.roll('avg', 'close', 200)})",
    "v3_beta_12m": "beta",
    "v3_corr_6m": "corr",
    "v3_idio_vol_6m": f"({X.roll('stddev_samp', 'resid', 126, 60)})*sqrt(252)",
}


_SNAPSHOT = f"""{X.DRET}, {_MKT}, q AS (SELECT d.*, bench_dret, close*volume AS dv, abs(dret)/nullif(close*volume,0) AS impact,
pow(ln(CASE WHEN high/low < 1 THEN 1.0 ELSE high/low END), 2) AS hl2, CASE WHEN dret < 0 THEN dret END AS down FROM dret d LEFT JOIN mret m ON m.date = d.date),
b AS (SELECT *, ({X.roll('covar_samp', 'dret,bench_dret', 252)})/({X.roll('var_samp', 'bench_dret', 252)}) AS beta, {X.roll('corr', 'dret,bench_dret', 126)} AS corr FROM q),
r AS (SELECT *, dret - beta*bench_dret AS resid FROM b),
df AS (SELECT ticker, date, {", ".join(f"{e} AS {c}" for c, e in _DAILY.items())} FROM r),
ff AS (SELECT ticker, date, {", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS {c}" for c in _DAILY)} FROM df),
ends AS (SELECT DISTINCT ticker, last_day(date) AS date FROM dgrid),
snap AS (SELECT e.ticker, e.date, {", ".join(_DAILY)} FROM ends e ASOF LEFT JOIN ff ON e.ticker = ff.ticker AND e.date >= ff.date)"""


@query("daily_feature_snapshot", f"WITH {_SNAPSHOT} SELECT * FROM snap", " ".join(_DAILY))
def daily_feature_snapshot(spark, sf):
    """All daily-bar features, read at each month end."""
    return _snapshot(spark, sf)


def _snapshot(spark, sf):
    bars = stage(X.daily(spark, sf), "bars")
    ends = bars.select("ticker", F.last_day("date").alias("date")).distinct()
    return feats.period_snapshot(feats.daily_features(by_ticker(bars), _daily_market(spark, sf)), ends)


@query(
    "macro_features",
    f"""WITH m AS (SELECT CAST(ts AS DATE) AS date, event_type AS series, CAST(sum(CAST(round(value*100) AS BIGINT)) AS DOUBLE)/CAST(100*count(value) AS DOUBLE) AS v
  FROM events GROUP BY 1, 2),
w AS (SELECT date, max(v) FILTER (series='view') AS view, max(v) FILTER (series='click') AS click, max(v) FILTER (series='error') AS error,
  max(v) FILTER (series='signup') AS signup, max(v) FILTER (series='purchase') AS purchase FROM m GROUP BY 1)
SELECT date, view AS v3m_level, view - lag(view) {X._B} AS v3m_level_chg,
(view - ({X.roll_all('avg', 'view', 12)}))/({X.roll_all('stddev_samp', 'view', 12)}) AS v3m_level_z,
click - error AS v3m_spread, (click - error) - lag(click - error, 3) {X._B} AS v3m_spread_chg,
signup/lag(signup, 3) {X._B} - 1 AS v3m_risky_ret, (signup/lag(signup, 3) {X._B} - 1) - (purchase/lag(purchase, 3) {X._B} - 1) AS v3m_appetite,
signup/max(signup) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS v3m_risky_drawdown,
purchase/({X.roll_all('avg', 'purchase', 10)}) AS v3m_market_to_ma FROM w""",
    "v3m_level v3m_level_chg v3m_level_z v3m_spread v3m_spread_chg v3m_risky_ret v3m_appetite v3m_risky_drawdown v3m_market_to_ma",
)
def macro_features(spark, sf):
    wide = feats.macro_wide(A.macro(spark, sf), ["view", "click", "error", "signup", "purchase"])
    return feats.macro_features(wide, "view", "click", "error", "signup", "purchase", "purchase")


# daily series out of the raw lines: one for each line number and each return flag
_SERIES = [*(f"L{i}" for i in range(1, 8)), "A", "N", "R"]
_ROLES = dict(zip("fear long_yield short_yield bonds gold risky safe large small market".split(), _SERIES))
_MACRO_COLUMNS = (
    "v3m_fear v3m_fear_chg_1m v3m_fear_z_12m v3m_long_yield v3m_short_yield v3m_term_spread v3m_term_spread_chg_3m v3m_bonds_ret_3m "
    "v3m_gold_ret_3m v3m_risky_ret_3m v3m_credit_appetite_3m v3m_risky_drawdown v3m_large_minus_small_3m v3m_market_to_ma10m"
)
_R3 = lambda c: f"({c}/lag({c}, 3) {X._B} - 1)"
MACRO_MONTHLY = f"""ml AS (SELECT CAST(l_shipdate AS DATE) AS date, unnest(['L'||l_linenumber, l_returnflag]) AS series, l_extendedprice, l_quantity FROM lineitem),
mv AS (SELECT date, series, {X._UNIT} AS v FROM ml GROUP BY 1, 2),
mw AS (SELECT date, {", ".join(f"max(v) FILTER (series = '{c}') AS {k}" for k, c in _ROLES.items())} FROM mv GROUP BY 1),
mf AS (SELECT date, {", ".join(f"last_value({k} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS {k}" for k in _ROLES)} FROM mw),
me AS (SELECT last_day(CAST(g AS DATE)) AS date FROM (SELECT unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS g FROM mf)),
mm AS (SELECT me.date, mf.* EXCLUDE (date) FROM me ASOF LEFT JOIN mf ON me.date >= mf.date),
macro AS (SELECT date, fear AS v3m_fear, fear - lag(fear) {X._B} AS v3m_fear_chg_1m,
(fear - ({X.roll_all('avg', 'fear', 12)}))/({X.roll_all('stddev_samp', 'fear', 12)}) AS v3m_fear_z_12m,
long_yield AS v3m_long_yield, short_yield AS v3m_short_yield, long_yield - short_yield AS v3m_term_spread,
(long_yield - short_yield) - lag(long_yield - short_yield, 3) {X._B} AS v3m_term_spread_chg_3m,
{_R3('bonds')} AS v3m_bonds_ret_3m, {_R3('gold')} AS v3m_gold_ret_3m, {_R3('risky')} AS v3m_risky_ret_3m, {_R3('risky')} - {_R3('safe')} AS v3m_credit_appetite_3m,
risky/max(risky) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS v3m_risky_drawdown, {_R3('large')} - {_R3('small')} AS v3m_large_minus_small_3m,
market/({X.roll_all('avg', 'market', 10)}) AS v3m_market_to_ma10m FROM mm)"""


def _macro_monthly(spark, sf):
    wide = feats.macro_wide(A.line_series(spark, sf), _SERIES)
    return feats.macro_monthly(stage(feats.macro_month_ends(wide), "macro"), _ROLES)


@query("macro_features_monthly", f"WITH {MACRO_MONTHLY} SELECT * FROM macro", _MACRO_COLUMNS)
def macro_features_monthly(spark, sf):
    """Macro columns at month ends: levels, changes, spreads and returns of ten daily series."""
    return _macro_monthly(spark, sf)


# the base features on the monthly prices of the brands that the daily bars tell of
_BASE = "ret_1m ret_3m ret_6m ret_12m price_to_ma_3m price_to_ma_6m price_to_ma_12m vol_3m vol_6m vol_12m stock_drawdown_6m stock_drawdown_12m stock_drawdown future_1m_return".split()
WIDENED = f"""bpx AS (SELECT ticker, last_day(date) AS date, arg_max(close, date) AS price FROM bars GROUP BY 1, 2),
bgrid AS (SELECT t.ticker, c.date, p.price FROM (SELECT DISTINCT ticker FROM bpx) t CROSS JOIN (SELECT DISTINCT date FROM bpx) c
  LEFT JOIN bpx p ON p.ticker = t.ticker AND p.date = c.date), {X.FEAT[X.FEAT.index("f1 AS"):].replace("FROM grid)", "FROM bgrid)")}"""


@query(
    "widened_features",
    f"""WITH {_SNAPSHOT}, {WIDENED}, {MACRO_MONTHLY}
SELECT f.ticker, f.date, f.price, {", ".join(f"f.{c}" for c in _BASE)}, s.* EXCLUDE (ticker, date), m.* EXCLUDE (date)
FROM feat f LEFT JOIN snap s ON s.ticker = f.ticker AND s.date = f.date LEFT JOIN macro m ON m.date = f.date""",
    " ".join([*_BASE, *_DAILY, *_MACRO_COLUMNS.split()]),
)
def widened_features(spark, sf):
    """The feature table of brands: base features of month-end closes, those of daily bars, and the macro columns."""
    closes = A.daily_bars(spark, sf).groupBy("ticker", F.last_day("date").alias("date")).agg(F.max_by("close", "date").alias("price"))
    closes = stage(closes, "closes")
    base = feats.stock_features(dense_grid(closes, closes, closes)).select("ticker", "date", "price", *_BASE)
    return feats.widened(base, _snapshot(spark, sf), _macro_monthly(spark, sf))


_CORRECTED = "date = DATE '1997-06-30' AND CAST(substr(ticker, 2) AS INT) % 3 = 0"


@query(
    "sector_relative_from_states",
    f"""WITH {X.FEAT}, c AS (SELECT ticker, date, CASE WHEN {_CORRECTED} THEN ret_1m + 0.01 ELSE ret_1m END AS ret_1m, CASE WHEN {_CORRECTED} THEN NULL ELSE ret_6m END AS ret_6m FROM feat),
j AS (SELECT c.*, sector FROM c JOIN uni u ON u.ticker = c.ticker)
SELECT ticker, date, sector, ret_1m - avg(ret_1m) OVER w AS ret_1m_minus_sector, ret_6m - avg(ret_6m) OVER w AS ret_6m_minus_sector,
count(ret_1m) OVER w AS known, CASE WHEN count(ret_1m) OVER w > 1 THEN stddev_samp(ret_1m) OVER w END AS ret_1m_std, 0::BIGINT AS computed_again FROM j WINDOW w AS (PARTITION BY date, sector)""",
    "ret_1m_minus_sector ret_6m_minus_sector ret_1m_std",
)
def sector_relative_from_states(spark, sf):
    """Returns less their sector's mean, out of states stored in three increments and corrected once. A further run over all
    periods finds none to compute."""
    by, columns = ["date", "sector"], ["ret_1m", "ret_6m"]
    rows = stage(X.feat(spark, sf).join(A.universe(spark, sf), "ticker").select("ticker", *by, *columns), "panel")
    path = new_path(spark, "sector-states")
    for upto in ("1996-12-31", "1999-12-31", "2100-01-01"):
        states.update(rows.filter(F.col("date") <= F.lit(upto).cast("date")), path, by, columns)
    hit = F.expr(_CORRECTED)
    right = rows.withColumn("ret_1m", F.when(hit, F.col("ret_1m") + 0.01).otherwise(F.col("ret_1m"))).withColumn(
        "ret_6m", F.when(~hit, F.col("ret_6m"))
    )
    states.correct(rows.filter(hit), right.filter(hit), path, by, columns)
    again = states.update(right, path, by, columns).count()
    means = states.merged(spark, path, by, columns)
    return right.join(means, by, "left").select(
        "ticker", *by, *[(F.col(c) - F.col(f"{c}_mean")).alias(f"{c}_minus_sector") for c in columns],
        F.coalesce("ret_1m_n", F.lit(0)).alias("known"), "ret_1m_std", F.lit(again).alias("computed_again"),
    )


@query(
    "scalar_functions",
    """SELECT o_orderkey, upper(trim(o_orderpriority)) AS code, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS level,
TRY_CAST(o_orderstatus AS DOUBLE) AS bad_number, o_totalprice/nullif(o_custkey % 5, 0) AS guarded, last_day(CAST(o_orderdate AS DATE)) AS month_end,
year(o_orderdate) AS year, date_diff('day', CAST(o_orderdate AS DATE), last_day(CAST(o_orderdate AS DATE))) AS days_left,
ln(o_totalprice) AS log_price, least(greatest(o_totalprice, 1000.0), 200000.0) AS clipped, floor(o_totalprice/1000) AS thousands FROM orders""",
    "level guarded log_price clipped thousands",
)
def scalar_functions(spark, sf):
    o = A.load(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    return o.select(
        "o_orderkey",
        S.clean_ticker("o_orderpriority").alias("code"),
        S.to_number(F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).alias("level"),
        S.to_number("o_orderstatus").alias("bad_number"),
        S.ratio("o_totalprice", F.col("o_custkey") % 5).alias("guarded"),
        S.month_end("o_orderdate").alias("month_end"),
        F.year(day).alias("year"),
        F.datediff(F.last_day(day), day).alias("days_left"),
        F.log("o_totalprice").alias("log_price"),
        S.clip("o_totalprice", 1000.0, 200000.0).alias("clipped"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("thousands"),
    )


@query(
    "universe_normalized",
    """SELECT upper(trim(c_mktsegment)) AS ticker, arg_min(c_name, c_custkey) AS company, 'Unknown' AS sector,
CAST(arg_min(c_nationkey, c_custkey) AS VARCHAR) AS industry FROM customer GROUP BY 1""",
)
def universe_normalized(spark, sf):
    """First row per ticker wins, a missing sector column becomes Unknown."""
    c = A.load(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("ticker"), F.col("c_name").alias("company"),
        F.col("c_nationkey").cast("string").alias("industry"), "c_custkey",
    )
    return normalize_universe(c, "c_custkey")


PROFILE = ["price", "ret_1m", "ret_12m", "vol_12m", "stock_drawdown"]


@query(
    "column_profile",
    f"WITH {X.FEAT} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, (count(*) - count({c}))/count(*)::DOUBLE AS missing_share, "
        f"avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max FROM feat" for c in PROFILE
    ),
    "missing_share mean std min max",
)
def column_profile(spark, sf):
    return cross.column_profile(X.feat(spark, sf), PROFILE)


@query(
    "feature_coverage",
    f"WITH {X.FEAT} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c})/count(*)::DOUBLE AS coverage FROM feat" for c in PROFILE
    ),
    "coverage",
)
def feature_coverage(spark, sf):
    return cross.coverage_share(X.feat(spark, sf), PROFILE)


@query(
    "feature_medians",
    f"WITH {X.FEAT} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, median({c}) AS median FROM feat" for c in PROFILE),
    "median",
)
def feature_medians(spark, sf):
    return medians.exact_medians(stage(X.feat(spark, sf).select(*PROFILE), "features"), PROFILE)


@query(
    "feature_medians_bracketed",
    f"WITH {X.FEAT} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, median({c}) AS median FROM feat" for c in PROFILE),
    "median",
)
def feature_medians_bracketed(spark, sf):
    """The same medians by the bracketing path that large inputs take."""
    return medians.exact_medians(stage(X.feat(spark, sf).select(*PROFILE), "features"), PROFILE, digit=3)


@query(
    "imputed_state",
    f"WITH {X.FEAT} SELECT ticker, date, " + ", ".join(
        f"coalesce({c}, (SELECT median({c}) FROM feat WHERE date <= DATE '1999-12-31'), 0) AS {c}" for c in PROFILE
    ) + " FROM feat",
    " ".join(PROFILE),
)
def imputed_state(spark, sf):
    """Point-in-time medians: only rows up to the as-of date give them."""
    import datetime as dt

    f = stage(X.feat(spark, sf).select("ticker", "date", *PROFILE), "features")
    return medians.impute(f, PROFILE, dt.date(1999, 12, 31))


STATE = (
    [f"ret_{n}m" for n in (1, 3, 6, 12)] + [f"price_ma_{n}m" for n in (3, 6, 12)] + ["stock_drawdown_6m", "stock_drawdown_12m", "stock_drawdown"]
    + [f"price_to_ma_{n}m" for n in (3, 6, 12)] + [f"vol_{n}m" for n in (3, 6, 12)] + [f"bench_ret_{n}m" for n in (1, 3, 6, 12)]
    + [f"bench_vol_{n}m" for n in (3, 6, 12)] + ["bench_drawdown"]
)


MADE = ("neighbor_avg_ret", "v3_range", "v3m_level")  # columns of the other kinds, made from the panel
SETS = {
    "original_only": (*STATE, *MADE[1:]),
    "neighbor_only": MADE[:1],
    "original_plus_neighbors": (*STATE, *MADE),
    "base_only": STATE,
    "state": (*STATE, *MADE[1:]),
}


@query(
    "feature_sets",
    f"WITH {X.LABELLED}, m AS (SELECT *, ret_1m/2 AS neighbor_avg_ret, vol_3m AS v3_range, bench_ret_1m AS v3m_level FROM lab) "
    + " UNION ALL ".join(f"SELECT '{s}' AS feature_set, '{c}' AS feature, count({c}) AS known FROM m" for s, cs in SETS.items() for c in cs),
)
def feature_sets(spark, sf):
    """The inputs of each feature set and how often they are known. The table also has outcome and key columns, neighbor
    columns, and daily and macro columns, which the sets must leave out or take in."""
    f = X.labelled(spark, sf).select(
        "*",
        (F.col("ret_1m") / 2).alias("neighbor_avg_ret"),
        F.col("vol_3m").alias("v3_range"),
        F.col("bench_ret_1m").alias("v3m_level"),
    )
    names = {s: feature_columns(f, s) for s in SETS}
    every = sorted({c for cs in names.values() for c in cs})
    counted = f.agg(*[F.count(c).alias(c) for c in every]).unpivot([], every, "feature", "known")
    holder = F.array_compact(F.array(*[F.when(F.col("feature").isin(cs), F.lit(s)) for s, cs in names.items()]))
    return counted.select(F.explode(holder).alias("feature_set"), "feature", "known")


@query("date_group_sizes", f"WITH {X.GRID} SELECT date, count(*) AS rows FROM grid GROUP BY 1")
def date_group_sizes(spark, sf):
    return cross.group_sizes(X.grid(spark, sf))


@query(
    "date_constants",
    f"WITH {X.LABELLED} SELECT date, max(bench_price) AS bench_price, max(bench_vol_12m) AS bench_vol_12m FROM lab GROUP BY 1",
    "bench_price bench_vol_12m",
)
def date_constants(spark, sf):
    return cross.date_constants(X.labelled(spark, sf), ["bench_price", "bench_vol_12m"])


@query(
    "scoreable_dates",
    f"""WITH {X.FEAT} SELECT * FROM (SELECT date, count(future_1m_return) AS labelled, row_number() OVER (ORDER BY date) - 1 AS position
FROM feat GROUP BY date) WHERE labelled > 0 AND position >= 36""",
)
def scoreable_dates(spark, sf):
    return cross.scoreable_dates(X.feat(spark, sf))


@query(
    "table_profiles",
    f"""WITH {X.PX}, {X.BARS} SELECT 'monthly' AS name, count(*) AS rows, 3::BIGINT AS columns, min(date) AS min_date, max(date) AS max_date, count(DISTINCT ticker) AS tickers FROM px
UNION ALL SELECT 'daily', count(*), 6, min(date), max(date), count(DISTINCT ticker) FROM bars""",
)
def table_profiles(spark, sf):
    return cross.table_profiles({"monthly": A.monthly_prices(spark, sf), "daily": A.daily_bars(spark, sf)})


@query(
    "best_and_worst",
    f"""WITH {X.FEAT} SELECT date, arg_min(ticker, (-ret_1m, ticker)) FILTER (ret_1m IS NOT NULL) AS best_ticker, max(ret_1m) AS best_ret_1m,
arg_min(ticker, (ret_1m, ticker)) FILTER (ret_1m IS NOT NULL) AS worst_ticker, min(ret_1m) AS worst_ret_1m FROM feat GROUP BY 1""",
    "best_ret_1m worst_ret_1m",
)
def best_and_worst(spark, sf):
    return X.feat(spark, sf).groupBy("date").agg(*cross.extremes("ret_1m"))


@query(
    "market_state",
    f"""WITH {X.LABELLED}, s AS (SELECT date, sector, avg(ret_1m) AS r FROM lab GROUP BY 1, 2),
d AS (SELECT date, stddev_samp(r) AS sector_dispersion FROM s GROUP BY 1)
SELECT l.date, avg(ret_1m) AS equal_weight_ret, stddev_samp(ret_1m) AS return_dispersion, avg((ret_1m > 0)::INT) AS breadth,
{", ".join(f"avg((price_to_ma_{n}m > 0)::INT) AS share_above_ma_{n}m" for n in (3, 6, 12))}, avg(vol_12m) AS avg_vol_12m,
avg(stock_drawdown) AS avg_drawdown, max(sector_dispersion) AS sector_dispersion FROM lab l JOIN d USING (date) GROUP BY 1""",
    "equal_weight_ret return_dispersion breadth share_above_ma_3m share_above_ma_6m share_above_ma_12m avg_vol_12m avg_drawdown sector_dispersion",
)
def market_state(spark, sf):
    return cross.market_state(stage(X.feat(spark, sf).join(A.universe(spark, sf), "ticker", "left"), "features"))


@query(
    "sector_scores",
    f"""WITH {X.LABELLED} SELECT ticker, date, {", ".join(f"{c} - avg({c}) OVER w AS {c}_minus_sector, ({c} - avg({c}) OVER w)/nullif(stddev_samp({c}) OVER w, 0) AS {c}_sector_z" for c in ("ret_1m", "vol_12m", "stock_drawdown"))}
FROM lab WINDOW w AS (PARTITION BY date, sector)""",
    " ".join(f"{c}_minus_sector {c}_sector_z" for c in ("ret_1m", "vol_12m", "stock_drawdown")),
)
def sector_scores(spark, sf):
    cols = ["ret_1m", "vol_12m", "stock_drawdown"]
    f = stage(X.feat(spark, sf).join(A.universe(spark, sf), "ticker", "left"), "features")
    return extras.sector_scores(f, cols).select(
        "ticker", "date", *[f"{c}_minus_sector" for c in cols], *[f"{c}_sector_z" for c in cols]
    )


@query(
    "size_buckets",
    """SELECT o_custkey, v, CASE WHEN v < 500000 THEN 'small' WHEN v < 1500000 THEN 'mid' ELSE 'large' END AS size_bucket
FROM (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/100 AS v FROM orders GROUP BY 1)""",
    "v",
)
def size_buckets(spark, sf):
    v = A.load(spark, sf, "orders").groupBy("o_custkey").agg((F.sum(A.cents("o_totalprice")).cast("double") / 100).alias("v"))
    return extras.size_buckets(v, "v", [("small", 500000.0), ("mid", 1500000.0)], "large")


@query(
    "forward_targets",
    f"""WITH {X.GRID} SELECT ticker, date, price, {", ".join(f"lead(price,{h}) {_D}/price - 1 AS future_{h}m_return" for h in (1, 3, 6, 12, 24, 36))} FROM grid""",
    "price " + " ".join(f"future_{h}m_return" for h in (1, 3, 6, 12, 24, 36)),
)
def forward_targets(spark, sf):
    return extras.forward_targets(X.grid(spark, sf))


@query(
    "top_fifth_target",
    f"""WITH {X.FEAT} SELECT ticker, date, CAST(row_number() OVER (PARTITION BY date ORDER BY future_1m_return, ticker)::DOUBLE/count(*) OVER (PARTITION BY date) > 0.8 AS BIGINT) AS target_top_quintile_1m
FROM feat WHERE future_1m_return IS NOT NULL""",
)
def top_fifth_target(spark, sf):
    f = X.feat(spark, sf).select("ticker", "date", "future_1m_return")
    return extras.top_fifth(f).drop("future_1m_return")


@query(
    "volatility_universes",
    f"""WITH {X.FEAT} SELECT ticker, date, vol_rank, CASE WHEN s <= 1.0::DOUBLE/3 THEN 'low' WHEN s <= 2.0::DOUBLE/3 THEN 'mid' ELSE 'high' END AS vol_bucket FROM
(SELECT ticker, date, row_number() OVER (PARTITION BY date ORDER BY vol_12m, ticker) AS vol_rank, row_number() OVER (PARTITION BY date ORDER BY vol_12m, ticker)::DOUBLE/count(*) OVER (PARTITION BY date) AS s
FROM feat WHERE vol_12m IS NOT NULL)""",
)
def volatility_universes(spark, sf):
    return extras.vol_universes(X.feat(spark, sf).select("ticker", "date", "vol_12m")).drop("vol_12m")


_LEAD = ", ".join(
    f"{lv}_ret_{n}m - bench_ret_{n}m AS {lv}_minus_bench_{n}m, ret_{n}m - {lv}_ret_{n}m AS stock_minus_{lv}_{n}m"
    for lv in ("sector", "industry") for n in (1, 12)
)


def _group_sql(level):
    return f"""{level}_g AS (SELECT date, {level}, avg(ret_1m) AS {level}_ret_1m, avg(ret_12m) AS {level}_ret_12m FROM lab GROUP BY 1, 2),
{level}_k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {level}_ret_12m DESC NULLS LAST, {level}) AS {level}_rank_by_date FROM {level}_g)"""


@query(
    "leadership",
    f"""WITH {X.LABELLED}, {_group_sql('sector')}, {_group_sql('industry')}
SELECT l.ticker, l.date, sector_rank_by_date, industry_rank_by_date, {_LEAD} FROM lab l JOIN sector_k s ON s.date = l.date AND s.sector = l.sector
JOIN industry_k i ON i.date = l.date AND i.industry = l.industry""",
    " ".join(f"{lv}_minus_bench_{n}m stock_minus_{lv}_{n}m" for lv in ("sector", "industry") for n in (1, 12)),
)
def leadership(spark, sf):
    out = extras.leadership(stage(X.labelled(spark, sf), "features"), (1, 12))
    return out.select(
        "ticker", "date", "sector_rank_by_date", "industry_rank_by_date",
        *[f"{lv}_minus_bench_{n}m" for lv in ("sector", "industry") for n in (1, 12)],
        *[f"stock_minus_{lv}_{n}m" for lv in ("sector", "industry") for n in (1, 12)],
    )


@query(
    "strength_rules",
    f"""WITH {X.LABELLED}, s AS (SELECT date, avg(ret_6m) AS s6, avg(ret_12m) AS s12, max(bench_ret_6m) AS b6, max(bench_ret_12m) AS b12 FROM lab WHERE sector = '{X.SECTOR}' GROUP BY 1)
SELECT date, NOT coalesce(s6 < b6, false) AS on_6m_vs_bench, NOT coalesce(s12 < b12, false) AS on_12m_vs_bench, NOT coalesce(s6 < 0, false) AS on_6m_positive FROM s""",
)
def strength_rules(spark, sf):
    return extras.strength_rules(X.labelled(spark, sf), X.SECTOR)


@query(
    "state_interactions",
    f"""WITH {X.LABELLED} SELECT ticker, date, ret_3m*bench_vol_12m AS ret_3m_x_bench_vol_12m, ret_3m*bench_drawdown AS ret_3m_x_bench_drawdown,
vol_12m*bench_vol_12m AS vol_12m_x_bench_vol_12m, vol_12m*bench_drawdown AS vol_12m_x_bench_drawdown FROM lab""",
    "ret_3m_x_bench_vol_12m ret_3m_x_bench_drawdown vol_12m_x_bench_vol_12m vol_12m_x_bench_drawdown",
)
def state_interactions(spark, sf):
    f = X.labelled(spark, sf).select("ticker", "date", "ret_3m", "vol_12m", "bench_vol_12m", "bench_drawdown")
    out = extras.interactions(f, ["ret_3m", "vol_12m"], ["bench_vol_12m", "bench_drawdown"])
    return out.drop("ret_3m", "vol_12m", "bench_vol_12m", "bench_drawdown")
