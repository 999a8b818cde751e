"""Inputs that many queries share, as Spark frames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.construct import Branch, branch_basket
from ..operators.features import stock_features, with_benchmark
from ..operators.shape import bounded_fill, dense_grid
from ..plans.staging import stage
from ..sources import adapters as A

SECTOR = "ASIA"
CORE = Branch("core", 20, 0.7)
SIDE = Branch("side", 10, 0.3)


def sums(spark: SparkSession, sf: str) -> DataFrame:
    """Per ticker and month sums of the raw lines, staged: the calendar, the prices and the benchmark all come
    from this one read."""
    return stage(A.monthly_sums(spark, sf), "monthly-sums")


def grid(spark: SparkSession, sf: str, read: DataFrame | None = None) -> DataFrame:
    p = A.with_price(read if read is not None else sums(spark, sf))
    return dense_grid(p, A.universe(spark, sf), p)


def feat(spark: SparkSession, sf: str, read: DataFrame | None = None) -> DataFrame:
    return stock_features(grid(spark, sf, read))


def bench(spark: SparkSession, sf: str, read: DataFrame | None = None) -> DataFrame:
    return A.benchmark_from(read if read is not None else A.monthly_sums(spark, sf))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Features, universe and benchmark, from one staged read of the raw lines."""
    read = sums(spark, sf)
    f = feat(spark, sf, read).join(A.universe(spark, sf), "ticker", "left")
    return with_benchmark(f, bench(spark, sf, read))


def basket(features: DataFrame, score: str, branch: Branch) -> DataFrame:
    return branch_basket(
        features.select("date", "ticker", "vol_12m", F.col(score).alias("ranker_score")), branch
    )


def book(features: DataFrame, score: str = "ret_6m", n: int = 10) -> DataFrame:
    """(date, ticker, weight) of the top n by score."""
    return basket(features, score, Branch("book", n, 1.0)).select(
        "date", "ticker", F.col("branch_inner_weight").alias("weight")
    )


BAR_FIELDS = ["close", "high", "low", "volume"]


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars on the dense brand x day grid, gaps filled for at most seven days."""
    bars = stage(A.daily_bars(spark, sf), "daily-bars")
    return bounded_fill(dense_grid(bars, bars, bars, BAR_FIELDS), BAR_FIELDS, 7)


_UNIT = (
    "CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)"
    "/CAST(100*sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)"
)
PX = f"""px AS (SELECT 'S'||l_suppkey AS ticker, last_day(CAST(l_shipdate AS DATE)) AS date, {_UNIT} AS price
  FROM lineitem GROUP BY 1, 2)"""
BENCH = f"""bench AS (SELECT last_day(CAST(l_shipdate AS DATE)) AS date, {_UNIT} AS price FROM lineitem GROUP BY 1)"""
UNI = """uni AS (SELECT 'S'||s_suppkey AS ticker, s_name AS company, r_name AS sector, n_name AS industry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
GRID = f"""{PX}, {UNI},
grid AS (SELECT u.ticker, c.date, p.price FROM uni u CROSS JOIN (SELECT DISTINCT date FROM px) c
  LEFT JOIN px p ON p.ticker = u.ticker AND p.date = c.date)"""


def roll(fn: str, c: str, n: int, min_obs: int | None = None) -> str:
    """Rolling aggregate in SQL, NULL until enough values are present."""
    frame = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    arg = c if "," not in c else None
    count = f"count({arg})" if arg else f"count(CASE WHEN {c.split(',')[0]} IS NOT NULL AND {c.split(',')[1]} IS NOT NULL THEN 1 END)"
    return f"CASE WHEN {count} {frame} >= {min_obs or n} THEN {fn}({c}) {frame} END"


_W = "OVER (PARTITION BY ticker ORDER BY date)"
FEAT = f"""{GRID},
f1 AS (SELECT ticker, date, price,
  {", ".join(f"price/lag(price,{n}) {_W} - 1 AS ret_{n}m" for n in (1, 3, 6, 12))},
  {", ".join(f"{roll('avg', 'price', n)} AS price_ma_{n}m" for n in (3, 6, 12))},
  {", ".join(f"price/({roll('max', 'price', n)}) - 1 AS stock_drawdown_{n}m" for n in (6, 12))},
  price/max(price) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS stock_drawdown
  FROM grid),
feat AS (SELECT *, {", ".join(f"price/price_ma_{n}m - 1 AS price_to_ma_{n}m" for n in (3, 6, 12))},
  {", ".join(f"{roll('stddev_samp', 'ret_1m', n)} AS vol_{n}m" for n in (3, 6, 12))},
  lead(ret_1m) {_W} AS future_1m_return FROM f1)"""
_B = "OVER (ORDER BY date)"


def roll_all(fn: str, c: str, n: int) -> str:
    frame = f"OVER (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {frame} >= {n} THEN {fn}({c}) {frame} END"


BENCHF = f"""{BENCH},
bf1 AS (SELECT date, price AS bench_price, {", ".join(f"price/lag(price,{n}) {_B} - 1 AS bench_ret_{n}m" for n in (1, 3, 6, 12))} FROM bench),
bf AS (SELECT *, {", ".join(f"{roll_all('stddev_samp', 'bench_ret_1m', n)} AS bench_vol_{n}m" for n in (3, 6, 12))},
  bench_price/max(bench_price) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS bench_drawdown,
  lead(bench_ret_1m) {_B} AS future_1m_bench_return FROM bf1)"""
LABELLED = f"""{FEAT}, {BENCHF},
lab AS (SELECT f.*, company, sector, industry, bf.* EXCLUDE (date),
  future_1m_return - future_1m_bench_return AS future_1m_excess_return,
  CASE WHEN future_1m_return - future_1m_bench_return > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target_outperform_1m
  FROM feat f LEFT JOIN uni u ON u.ticker = f.ticker LEFT JOIN bf ON bf.date = f.date)"""


def basket_sql(name: str, score: str, n: int, source: str = "feat") -> str:
    """CTEs for the top-n inverse-volatility basket per date."""
    return f"""{name}_r AS (SELECT date, ticker, {score} AS ranker_score, vol_12m,
  row_number() OVER (PARTITION BY date ORDER BY {score} DESC, ticker) AS rank_by_date
  FROM {source} WHERE {score} IS NOT NULL QUALIFY rank_by_date <= {n}),
{name}_i AS (SELECT *, coalesce(1/nullif(vol_12m,0), median(1/nullif(vol_12m,0)) OVER (PARTITION BY date)) AS inv FROM {name}_r),
{name} AS (SELECT date, ticker, ranker_score, rank_by_date,
  coalesce(inv/nullif(sum(inv) OVER (PARTITION BY date),0), 1.0::DOUBLE/count(*) OVER (PARTITION BY date)) AS branch_inner_weight
  FROM {name}_i)"""


BOOK = f"""{FEAT}, {basket_sql('b6', 'ret_6m', 10)},
book AS (SELECT date, ticker, branch_inner_weight AS weight FROM b6)"""
BLEND = f"""{FEAT}, {basket_sql('core', 'ret_6m', 20)}, {basket_sql('side', 'ret_12m', 10)},
legs AS (SELECT date, ticker, ranker_score, rank_by_date, 'core' AS branch, branch_inner_weight*0.7 AS w FROM core
  UNION ALL SELECT date, ticker, ranker_score, rank_by_date, 'side', branch_inner_weight*0.3 FROM side),
blend0 AS (SELECT date, ticker, sum(w) AS w, string_agg(branch, ', ' ORDER BY branch) AS branches,
  avg(ranker_score) AS avg_ranker_score, min(rank_by_date) AS best_rank FROM legs GROUP BY 1, 2),
blend AS (SELECT date, ticker, w/sum(w) OVER (PARTITION BY date) AS final_weight_before_regime, branches,
  avg_ranker_score, best_rank FROM blend0)"""
REGIME = f"""reg1 AS (SELECT g.ticker, g.date, g.price, g.price/lag(g.price) OVER (PARTITION BY g.ticker ORDER BY g.date) - 1 AS r
  FROM grid g JOIN uni u ON u.ticker = g.ticker WHERE u.sector = '{SECTOR}'),
reg2 AS (SELECT date, avg(r) AS r FROM reg1 GROUP BY 1),
reg3 AS (SELECT date, exp(sum(ln(1 + coalesce(r, 0))) OVER (ORDER BY date)) AS idx FROM reg2),
regime AS (SELECT date, idx/max(idx) OVER (ORDER BY date) - 1 AS regime_drawdown,
  idx/max(idx) OVER (ORDER BY date) - 1 > -0.20 AS risk_on FROM reg3)"""
FINAL = f"""{BLEND}, {REGIME},
fin0 AS (SELECT b.*, CASE WHEN r.risk_on THEN 0.0 ELSE 0.5 END AS cash FROM blend b LEFT JOIN regime r USING (date)),
fin1 AS (SELECT date, ticker, final_weight_before_regime, branches, avg_ranker_score, best_rank,
    final_weight_before_regime*(1-cash) AS w FROM fin0
  UNION ALL SELECT date, 'CASH', 0.0, 'regime_filter', NULL, NULL, max(cash) FROM fin0 WHERE cash > 0 GROUP BY date),
fin AS (SELECT * EXCLUDE (w), w/sum(w) OVER (PARTITION BY date) AS final_weight FROM fin1)"""
DAILY_UNIT = _UNIT
BARS = f"""bars AS (SELECT upper(p_brand) AS ticker, CAST(l_shipdate AS DATE) AS date, {_UNIT} AS close,
  max(l_extendedprice/l_quantity) AS high, min(l_extendedprice/l_quantity) AS low,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
dgrid AS (SELECT t.ticker, d.date, close, high, low, volume FROM (SELECT DISTINCT ticker FROM bars) t
  CROSS JOIN (SELECT DISTINCT date FROM bars) d LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = d.date)"""
_FILLED = ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS {c}"
    for c in BAR_FIELDS
)
DRET = f"""{BARS},
dfill AS (SELECT ticker, date, {_FILLED} FROM dgrid),
dpad AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS pc FROM dfill),
dret AS (SELECT * EXCLUDE (pc), pc/lag(pc) {_W} - 1 AS dret FROM dpad)"""
