"""Portfolio construction and evaluation queries (T-2, A7, A10, P1-P13, E1-E15, D4-D7, D12-D14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import construct as C, extras, perf
from ..plans import grid as G
from ..plans.staging import stage
from ..sources import adapters as A
from . import fixtures as X
from .registry import query

STATS = (
    "total_return ann_return ann_vol sharpe sortino max_dd best_month worst_month positive_share "
    "information_ratio hit_rate"
)


def stats_sql(source: str, by: str, bench: str | None = "bench_ret") -> str:
    """Statistics per series of ``source`` (by..., date, ret[, bench])."""
    rel = (
        f""", CASE WHEN count(ret - {bench}) >= 2 THEN avg(ret - {bench})/nullif(stddev_samp(ret - {bench}),0)*sqrt(12) END AS information_ratio,
avg(CASE WHEN {bench} IS NULL THEN NULL WHEN ret > {bench} THEN 1.0 ELSE 0.0 END) AS hit_rate"""
        if bench else ""
    )
    return f"""SELECT {by}, count(ret) AS months, min(date) AS start, max(date) AS "end", product(1+ret) - 1 AS total_return,
CASE WHEN product(1+ret) <= 0 THEN -1.0 ELSE pow(product(1+ret), 12.0::DOUBLE/count(ret)) - 1 END AS ann_return,
CASE WHEN count(ret) >= 2 THEN stddev_samp(ret)*sqrt(12) END AS ann_vol,
CASE WHEN count(ret) >= 2 THEN avg(ret)/nullif(stddev_samp(ret),0)*sqrt(12) END AS sharpe,
CASE WHEN count(ret) < 2 THEN NULL WHEN count(*) FILTER (ret < 0) = 0 THEN 'Infinity'::DOUBLE
  ELSE avg(ret)/nullif(sqrt(avg(ret*ret) FILTER (ret < 0)),0)*sqrt(12) END AS sortino,
min(dd) AS max_dd, max(ret) AS best_month, min(ret) AS worst_month, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS positive_share{rel}
FROM (SELECT *, eq/max(eq) OVER (PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM
  (SELECT *, product(1+ret) OVER (PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM {source} WHERE ret IS NOT NULL))
GROUP BY {by}"""


def turnover_sql(held: str, by: str = "") -> str:
    """CTEs gross, turn and net for a table held(by..., date, ticker, weight, ret)."""
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""g AS (SELECT {k}date, sum(weight*coalesce(ret,0)) AS gross_return FROM {held} GROUP BY {k}date),
nx AS (SELECT *, lead(date) OVER ({part}ORDER BY date) AS next_date FROM g),
drift AS (SELECT {", ".join(f"h.{c.strip()}" for c in by.split(",")) + "," if by else ""} next_date AS date, ticker, weight*(1+coalesce(ret,0))/(1+gross_return) AS weight
  FROM {held} h JOIN nx ON h.date = nx.date {" ".join(f"AND h.{c.strip()} = nx.{c.strip()}" for c in by.split(",")) if by else ""} WHERE next_date IS NOT NULL),
moves AS (SELECT {k}date, ticker, weight AS w FROM {held} UNION ALL SELECT {k}date, ticker, -weight FROM drift),
turn AS (SELECT {k}date, sum(abs(w)) AS turnover FROM (SELECT {k}date, ticker, sum(w) AS w FROM moves WHERE ticker <> 'CASH' GROUP BY {k}date, ticker) GROUP BY {k}date),
net AS (SELECT {", ".join(f"g.{c.strip()}" for c in by.split(",")) + "," if by else ""} g.date, gross_return, turnover, turnover*0.001 AS cost, gross_return - turnover*0.001 AS net_return
  FROM g JOIN turn ON turn.date = g.date {" ".join(f"AND turn.{c.strip()} = g.{c.strip()}" for c in by.split(",")) if by else ""})"""


HELD = f"""{X.BOOK}, {X.BENCHF},
held AS (SELECT b.date, b.ticker, b.weight, f.future_1m_return AS ret FROM book b LEFT JOIN feat f ON f.date = b.date AND f.ticker = b.ticker),
{turnover_sql('held')},
series AS (SELECT 1 AS series_id, net.date, net_return AS ret, bf.future_1m_bench_return AS bench_ret FROM net LEFT JOIN bf ON bf.date = net.date)"""


def _features(spark, sf, read=None):
    return stage(X.feat(spark, sf, read), "features")


def _held(spark, sf, read=None):
    f = _features(spark, sf, read)
    return perf.attach_returns(X.book(f), f)


def _bench_returns(spark, sf, read=None):
    from ..operators.features import benchmark_features

    return benchmark_features(X.bench(spark, sf, read)).select("date", F.col("future_1m_bench_return").alias("bench_ret"))


def _series(spark, sf):
    read = X.sums(spark, sf)
    net = perf.net_returns(stage(_held(spark, sf, read), "held"))
    return net.select(F.lit(1).alias("series_id"), "date", F.col("net_return").alias("ret")).join(
        _bench_returns(spark, sf, read), "date", "left"
    )


@query(
    "momentum_basket",
    f"""WITH {X.BOOK} SELECT date, ticker, ranker_score, rank_by_date, branch_inner_weight FROM b6""",
    "ranker_score branch_inner_weight",
)
def momentum_basket(spark, sf):
    out = X.basket(X.feat(spark, sf), "ret_6m", C.Branch("book", 10, 1.0))
    return out.select("date", "ticker", "ranker_score", "rank_by_date", "branch_inner_weight")


@query("blended_weights", f"WITH {X.BLEND} SELECT * FROM blend", "final_weight_before_regime avg_ranker_score")
def blended_weights(spark, sf):
    f = _features(spark, sf)
    return C.blend([X.basket(f, "ret_6m", X.CORE), X.basket(f, "ret_12m", X.SIDE)])


@query("sector_regime", f"WITH {X.GRID}, {X.REGIME} SELECT *, 0.5::DOUBLE AS cash_weight_when_off FROM regime", "regime_drawdown")
def sector_regime(spark, sf):
    return C.regime_status(X.grid(spark, sf), A.universe(spark, sf), X.SECTOR, -0.20, 0.5)


def final_portfolio_of(spark, sf, read=None) -> DataFrame:
    f = _features(spark, sf, read)
    scored = [
        (f.select("date", "ticker", "vol_12m", F.col(c).alias("ranker_score")), b)
        for c, b in (("ret_6m", X.CORE), ("ret_12m", X.SIDE))
    ]
    regime = C.regime_status(f.select("ticker", "date", "price"), A.universe(spark, sf), X.SECTOR, -0.20, 0.5)
    return C.build_portfolio(scored, regime)[0]


@query("final_portfolio", f"WITH {X.FINAL} SELECT * FROM fin", "final_weight_before_regime avg_ranker_score final_weight")
def final_portfolio(spark, sf):
    return final_portfolio_of(spark, sf)


@query(
    "dip_tilted_book",
    f"""WITH {X.BOOK}, t AS (SELECT b.date, b.ticker, b.weight, b.weight*least(greatest(1 - (coalesce(1 + f.price_to_ma_6m, 1) - 1), 0.5), 1.5) AS t
FROM book b LEFT JOIN feat f ON f.date = b.date AND f.ticker = b.ticker)
SELECT date, ticker, weight, t*sum(weight) OVER (PARTITION BY date)/sum(t) OVER (PARTITION BY date) AS tilted_weight FROM t""",
    "weight tilted_weight",
)
def dip_tilted_book(spark, sf):
    f = _features(spark, sf)
    near = f.select("date", "ticker", (1.0 + F.col("price_to_ma_6m")).alias("ratio_to_ma"))
    return C.dip_tilt(X.book(f).join(near, ["date", "ticker"], "left")).drop("ratio_to_ma")


@query(
    "trend_switch",
    f"""WITH {X.BENCH} SELECT date, price/({X.roll_all('avg', 'price', 10)}) AS price_to_ma, coalesce(price >= ({X.roll_all('avg', 'price', 10)}), true) AS trend_on FROM bench""",
    "price_to_ma",
)
def trend_switch(spark, sf):
    return C.trend_on(X.bench(spark, sf))


HEDGE = f"""{X.BENCHF}, state AS (SELECT date, bench_price/({X.roll_all('avg', 'bench_price', 10)}) AS tr, bench_vol_12m*100 AS lv, bench_drawdown AS cr FROM bf),
rules AS (SELECT date, CASE WHEN tr < 1 THEN 0.4 ELSE 1.0 END AS trend, CASE WHEN lv > 30 THEN 0.4 ELSE 1.0 END AS vix, CASE WHEN cr < -0.05 THEN 0.4 ELSE 1.0 END AS credit FROM state),
hedges AS (SELECT date, 'none' AS hedge, 1.0::DOUBLE AS exposure FROM rules UNION ALL SELECT date, 'trend', trend FROM rules UNION ALL SELECT date, 'vix', vix FROM rules
UNION ALL SELECT date, 'credit', credit FROM rules UNION ALL SELECT date, 'trend_or_credit', least(trend, credit) FROM rules)"""


def _hedges(spark, sf, read=None):
    from ..functions.rolling import Rolling
    from ..functions.scalars import ratio
    from ..operators.features import benchmark_features

    t = Rolling("_one")
    b = benchmark_features(X.bench(spark, sf, read)).withColumn("_one", F.lit(1))
    state = b.select(
        "date", ratio("bench_price", t.mean("bench_price", 10)).alias("market_to_ma"),
        (F.col("bench_vol_12m") * 100).alias("level"), F.col("bench_drawdown").alias("credit_drawdown"),
    )
    return C.hedge_exposures(state)


@query("hedge_exposures", f"WITH {HEDGE} SELECT * FROM hedges", "exposure")
def hedge_exposures(spark, sf):
    return _hedges(spark, sf)


@query(
    "vol_target_exposure",
    f"""WITH {HELD}, v AS (SELECT series_id, date, ret, CASE WHEN count(ret) OVER w >= 6 THEN stddev_samp(ret) OVER w*sqrt(12) END AS vol FROM series
WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT series_id::BIGINT AS series_id, date, ret, CASE WHEN vol > 0 THEN least(0.15/vol, 1.0) ELSE 1.0 END AS exposure FROM v""",
    "ret exposure",
)
def vol_target_exposure(spark, sf):
    return C.vol_target(_series(spark, sf).select("series_id", "date", "ret"))


@query(
    "no_trade_band",
    f"""WITH {HELD}, j AS (SELECT coalesce(h.date, d.date) AS date, coalesce(h.ticker, d.ticker) AS ticker, coalesce(h.weight, 0) AS target_weight, coalesce(d.weight, 0) AS drifted_weight
FROM held h FULL OUTER JOIN drift d ON d.date = h.date AND d.ticker = h.ticker)
SELECT * FROM (SELECT *, CASE WHEN abs(target_weight - drifted_weight) > 0.05 THEN target_weight ELSE drifted_weight END AS weight FROM j) WHERE weight <> 0""",
    "target_weight drifted_weight weight",
)
def no_trade_band(spark, sf):
    held = stage(_held(spark, sf), "held")
    return C.no_trade_band(held, perf.drifted(held), 0.05)


@query(
    "rank_buffer",
    f"""WITH {X.FEAT}, r AS (SELECT date, ticker, CASE WHEN ret_6m IS NOT NULL THEN row_number() OVER (PARTITION BY date, ret_6m IS NULL ORDER BY ret_6m DESC, ticker) END AS rank_by_date FROM feat),
e AS (SELECT *, CASE WHEN rank_by_date <= 20 THEN true WHEN rank_by_date IS NULL OR rank_by_date > 40 THEN false END AS ev FROM r)
SELECT date, ticker, rank_by_date, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), false) AS held FROM e""",
)
def rank_buffer(spark, sf):
    from ..operators.ranks import score_rank

    f = _features(spark, sf).select("date", "ticker", "ret_6m")
    ranked = score_rank(f.filter("ret_6m is not null"), "ret_6m").select("date", "ticker", "rank_by_date")
    return C.rank_buffer(f.select("date", "ticker").join(ranked, ["date", "ticker"], "left"))


@query(
    "sector_capped_top",
    f"""WITH {X.LABELLED}, s AS (SELECT date, ticker, sector, ret_6m, row_number() OVER (PARTITION BY date, sector ORDER BY ret_6m DESC, ticker) AS sector_rank FROM lab WHERE ret_6m IS NOT NULL QUALIFY sector_rank <= 3)
SELECT date, ticker, sector, sector_rank, row_number() OVER (PARTITION BY date ORDER BY ret_6m DESC, ticker) AS rank_by_date FROM s QUALIFY rank_by_date <= 10""",
)
def sector_capped_top(spark, sf):
    f = X.feat(spark, sf).filter("ret_6m is not null").join(A.universe(spark, sf), "ticker")
    out = C.sector_capped(f.select("date", "ticker", "sector", F.col("ret_6m").alias("ranker_score")), 10, 3)
    return out.drop("ranker_score")


@query(
    "low_volatility_top",
    f"""WITH {X.FEAT} SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY ret_6m DESC, ticker) AS rank_by_date FROM feat
WHERE vol_12m < 0.45 AND ret_6m IS NOT NULL QUALIFY rank_by_date <= 10""",
)
def low_volatility_top(spark, sf):
    f = X.feat(spark, sf).filter("ret_6m is not null")
    return extras.low_vol_top_n(f, 10, 0.45, score="ret_6m").select("date", "ticker", "rank_by_date")


@query(
    "period_returns",
    f"""WITH {X.FINAL}, h AS (SELECT b.date, b.ticker, final_weight AS weight, CASE WHEN b.ticker = 'CASH' THEN 0.0 ELSE future_1m_return END AS ret FROM fin b
LEFT JOIN feat f ON f.date = b.date AND f.ticker = b.ticker)
SELECT date, sum(weight*coalesce(ret,0)) AS gross_return, count(*) FILTER (ticker <> 'CASH') AS n_positions, coalesce(sum(weight) FILTER (ticker = 'CASH'), 0) AS cash_weight,
coalesce(sum(weight) FILTER (ret IS NULL), 0) AS missing_return_weight FROM h GROUP BY 1""",
    "gross_return cash_weight missing_return_weight",
)
def period_returns(spark, sf):
    book = final_portfolio_of(spark, sf).select("date", "ticker", F.col("final_weight").alias("weight"))
    return perf.gross_returns(perf.attach_returns(book, X.feat(spark, sf)))


@query(
    "turnover_and_cost", f"WITH {HELD} SELECT * FROM net",
    "gross_return turnover cost net_return",
)
def turnover_and_cost(spark, sf):
    net = perf.net_returns(stage(_held(spark, sf), "held"))
    return net.select("date", "gross_return", "turnover", "cost", "net_return")


FINAL_HELD = f"""{X.FINAL}, held AS (SELECT b.date, b.ticker, final_weight AS weight, CASE WHEN b.ticker = 'CASH' THEN 0.0 ELSE future_1m_return END AS ret FROM fin b
LEFT JOIN feat f ON f.date = b.date AND f.ticker = b.ticker), {turnover_sql('held')}"""


@query("turnover_with_cash", f"WITH {FINAL_HELD} SELECT date, turnover, net_return FROM net", "turnover net_return")
def turnover_with_cash(spark, sf):
    book = final_portfolio_of(spark, sf).select("date", "ticker", F.col("final_weight").alias("weight"))
    held = stage(perf.attach_returns(book, X.feat(spark, sf)), "held")
    return perf.net_returns(held).select("date", "turnover", "net_return")


@query("performance_summary", f"WITH {HELD} SELECT * REPLACE (series_id::BIGINT AS series_id) FROM ({stats_sql('series', 'series_id')})", STATS)
def performance_summary(spark, sf):
    return perf.summarize(_series(spark, sf), ["series_id"], bench="bench_ret")


FOLDS = "folded AS (SELECT *, ntile(5) OVER (PARTITION BY series_id ORDER BY date) AS fold FROM series WHERE ret IS NOT NULL)"


@query(
    "performance_by_fold",
    f"WITH {HELD}, {FOLDS} SELECT * REPLACE (series_id::BIGINT AS series_id) FROM ({stats_sql('folded', 'series_id, fold')})", STATS,
)
def performance_by_fold(spark, sf):
    return perf.by_fold(_series(spark, sf), 5, ["series_id"], bench="bench_ret")


@query(
    "performance_by_year",
    f"""WITH {HELD}, y AS (SELECT *, year(date) AS year FROM series)
SELECT * REPLACE (series_id::BIGINT AS series_id) FROM ({stats_sql('y', 'series_id, year')})""", STATS,
)
def performance_by_year(spark, sf):
    return perf.by_year(_series(spark, sf), ["series_id"], bench="bench_ret")


@query(
    "fold_dispersion",
    f"""WITH {HELD}, {FOLDS} SELECT series_id::BIGINT AS series_id, avg(sharpe) AS fold_sharpe_mean, stddev_samp(sharpe) AS fold_sharpe_std, min(sharpe) AS fold_sharpe_min
FROM ({stats_sql('folded', 'series_id, fold')}) GROUP BY 1""",
    "fold_sharpe_mean fold_sharpe_std fold_sharpe_min",
)
def fold_dispersion(spark, sf):
    return perf.fold_dispersion(perf.by_fold(_series(spark, sf), 5, ["series_id"]), ["series_id"])


def _variant_books(spark, sf, read):
    """Baseline, dip-tilted and trend-hedged versions of one book."""
    f = _features(spark, sf, read)
    base = stage(X.book(f), "book")
    near = f.select("date", "ticker", (1.0 + F.col("price_to_ma_6m")).alias("ratio_to_ma"))
    tilted = C.dip_tilt(base.join(near, ["date", "ticker"], "left")).select("date", "ticker", F.col("tilted_weight").alias("weight"))
    off = C.trend_on(X.bench(spark, sf, read)).select("date", F.when(F.col("trend_on"), 1.0).otherwise(0.4).alias("_e"))
    trend = base.join(off, "date", "left").select(
        "date", "ticker", (F.col("weight") * F.coalesce("_e", F.lit(1.0))).alias("weight")
    )
    named = {"baseline": base, "dip_tilt": tilted, "trend_hedge": trend}
    return reduce(DataFrame.unionByName, [b.withColumn("variant", F.lit(n)) for n, b in named.items()]), f


VARIANTS = f"""{X.BOOK}, {X.BENCHF},
tl AS (SELECT b.date, b.ticker, b.weight, b.weight*least(greatest(1 - (coalesce(1 + f.price_to_ma_6m, 1) - 1), 0.5), 1.5) AS t FROM book b LEFT JOIN feat f ON f.date = b.date AND f.ticker = b.ticker),
tw AS (SELECT date, CASE WHEN coalesce(price >= ({X.roll_all('avg', 'price', 10)}), true) THEN 1.0 ELSE 0.4 END AS e FROM bench),
vb AS (SELECT 'baseline' AS variant, date, ticker, weight FROM book UNION ALL
SELECT 'dip_tilt', date, ticker, t*sum(weight) OVER (PARTITION BY date)/sum(t) OVER (PARTITION BY date) FROM tl UNION ALL
SELECT 'trend_hedge', b.date, b.ticker, b.weight*coalesce(e, 1) FROM book b LEFT JOIN tw ON tw.date = b.date),
held AS (SELECT b.variant, b.date, b.ticker, b.weight, f.future_1m_return AS ret FROM vb b LEFT JOIN feat f ON f.date = b.date AND f.ticker = b.ticker),
{turnover_sql('held', 'variant')},
series AS (SELECT variant, net.date, net_return AS ret, future_1m_bench_return AS bench_ret FROM net LEFT JOIN bf ON bf.date = net.date UNION ALL
SELECT 'buy_and_hold', date, future_1m_bench_return, NULL FROM bf WHERE date IN (SELECT date FROM net)),
folded AS (SELECT *, ntile(5) OVER (PARTITION BY variant ORDER BY date) AS fold FROM series WHERE ret IS NOT NULL),
fs AS (SELECT variant, avg(sharpe) AS fold_sharpe_mean, stddev_samp(sharpe) AS fold_sharpe_std, min(sharpe) AS fold_sharpe_min FROM ({stats_sql('folded', 'variant, fold')}) GROUP BY 1),
tr AS (SELECT variant, avg(turnover) AS avg_turnover, avg(cost)*12 AS avg_cost_annualized FROM net GROUP BY 1)"""


@query(
    "variant_comparison",
    f"WITH {VARIANTS} SELECT s.*, fs.* EXCLUDE (variant), tr.* EXCLUDE (variant) FROM ({stats_sql('series', 'variant')}) s JOIN fs ON fs.variant = s.variant LEFT JOIN tr ON tr.variant = s.variant",
    STATS + " fold_sharpe_mean fold_sharpe_std fold_sharpe_min avg_turnover avg_cost_annualized",
)
def variant_comparison(spark, sf):
    read = X.sums(spark, sf)
    books, f = _variant_books(spark, sf, read)
    held = stage(perf.attach_returns(books, f), "held")
    net = stage(perf.net_returns(held, by=["variant"]), "net")
    bench = _bench_returns(spark, sf, read).join(net.select("date").distinct(), "date", "left_semi")
    return perf.compare_variants(net, bench, 5)


# two original and four neighbor branches; the feature panel's own trends stand in for their scores
ORIGINALS, NEIGHBORS = ["ret_6m", "ret_12m"], ["ret_1m", "ret_3m", "price_to_ma_6m", "price_to_ma_12m"]
# fixed: basket sizes and blends of the construction grid
ORIGINAL_SIZES, NEIGHBOR_SIZES, BLENDS = [10, 20, 35, 50], [5, 10, 20], [(0.7, 0.3), (0.5, 0.5)]
GRID_SIZES = {b: ORIGINAL_SIZES for b in ORIGINALS} | {b: NEIGHBOR_SIZES for b in NEIGHBORS}


def _values(items) -> str:
    return ", ".join(f"({i!r})" for i in items)


_ALL_SIZES = " UNION ALL ".join(
    f"SELECT '{b}' AS branch, {n} AS top_n, date, ticker, {b} AS s, vol_12m, row_number() OVER (PARTITION BY date ORDER BY {b} DESC, ticker) AS rk FROM feat WHERE {b} IS NOT NULL QUALIFY rk <= {n}"
    for b, ns in GRID_SIZES.items() for n in ns
)
GRID_SQL = f"""{X.FEAT}, {HEDGE},
sl0 AS ({_ALL_SIZES}),
sl1 AS (SELECT *, coalesce(1/nullif(vol_12m,0), median(1/nullif(vol_12m,0)) OVER (PARTITION BY branch, top_n, date)) AS inv FROM sl0),
sl AS (SELECT branch, top_n, date, ticker, coalesce(inv/nullif(sum(inv) OVER (PARTITION BY branch, top_n, date),0), 1.0::DOUBLE/count(*) OVER (PARTITION BY branch, top_n, date)) AS weight FROM sl1),
cd AS (SELECT date FROM sl GROUP BY 1 HAVING count(DISTINCT branch) = {len(GRID_SIZES)}),
og AS (SELECT * FROM (VALUES {_values(ORIGINALS)}) a(o) CROSS JOIN (VALUES {_values(ORIGINAL_SIZES)}) b(otn)),
ng AS (SELECT * FROM (VALUES {_values(NEIGHBORS)}) a(n) CROSS JOIN (VALUES {_values(NEIGHBOR_SIZES)}) b(ntn)),
hn AS (SELECT * FROM (VALUES {_values(C.HEDGES)}) a(hedge)),
vr AS (SELECT o AS orig_feats, otn::VARCHAR AS orig_topn, '-' AS neigh_dim, '-' AS neigh_topn, 1.0 AS wo, 0.0 AS wn, '100/0' AS blend FROM og
UNION ALL SELECT o, otn::VARCHAR, n, ntn::VARCHAR, wo, wn, bl FROM og CROSS JOIN ng CROSS JOIN (VALUES (0.7, 0.3, '70/30'), (0.5, 0.5, '50/50')) c(wo, wn, bl)
UNION ALL SELECT '-', '-', n, ntn::VARCHAR, 0.0, 1.0, '0/100' FROM ng),
bk AS (SELECT orig_feats, orig_topn, neigh_dim, neigh_topn, blend, sl.date, ticker, sum(weight*CASE WHEN branch = orig_feats AND top_n::VARCHAR = orig_topn THEN wo::DOUBLE ELSE wn::DOUBLE END) AS w
FROM vr JOIN sl ON (sl.branch = orig_feats AND top_n::VARCHAR = orig_topn AND wo > 0) OR (sl.branch = neigh_dim AND top_n::VARCHAR = neigh_topn AND wn > 0) JOIN cd ON cd.date = sl.date GROUP BY ALL),
bkn AS (SELECT * EXCLUDE (w), w/sum(w) OVER (PARTITION BY orig_feats, orig_topn, neigh_dim, neigh_topn, blend, date) AS w FROM bk),
held AS (SELECT concat_ws('|', orig_feats, orig_topn, neigh_dim, neigh_topn, blend) AS variant, hn.hedge, b.date, b.ticker, w*coalesce(exposure, 1.0) AS weight, future_1m_return AS ret
FROM bkn b CROSS JOIN hn LEFT JOIN hedges h ON h.date = b.date AND h.hedge = hn.hedge LEFT JOIN feat f ON f.date = b.date AND f.ticker = b.ticker),
{turnover_sql('held', 'variant, hedge')},
series AS (SELECT variant, hedge, net.date, net_return AS ret, future_1m_bench_return AS bench_ret FROM net LEFT JOIN bf ON bf.date = net.date),
folded AS (SELECT *, ntile(5) OVER (PARTITION BY variant, hedge ORDER BY date) AS fold FROM series WHERE ret IS NOT NULL),
fs AS (SELECT variant, hedge, avg(sharpe) AS fold_sharpe_mean, stddev_samp(sharpe) AS fold_sharpe_std, min(sharpe) AS fold_sharpe_min FROM ({stats_sql('folded', 'variant, hedge, fold')}) GROUP BY 1, 2),
st AS (SELECT s.*, fs.* EXCLUDE (variant, hedge), vr.* EXCLUDE (wo, wn) FROM ({stats_sql('series', 'variant, hedge')}) s JOIN fs ON fs.variant = s.variant AND fs.hedge = s.hedge
JOIN vr ON s.variant = concat_ws('|', orig_feats, orig_topn, neigh_dim, neigh_topn, blend))"""


def _grid(spark, sf):
    read = X.sums(spark, sf)
    f = _features(spark, sf, read)
    long = f.select("date", "ticker", "vol_12m", *GRID_SIZES).unpivot(
        ["date", "ticker", "vol_12m"], list(GRID_SIZES), "branch", "ranker_score"
    ).filter("ranker_score is not null")
    v = G.variants(spark, ORIGINALS, ORIGINAL_SIZES, NEIGHBORS, NEIGHBOR_SIZES, BLENDS)
    return G.run_grid(v, G.sleeves(long, GRID_SIZES), _hedges(spark, sf, read), f, _bench_returns(spark, sf, read))


@query("construction_grid", f"WITH {GRID_SQL} SELECT * FROM st", STATS + " fold_sharpe_mean fold_sharpe_std fold_sharpe_min")
def construction_grid(spark, sf):
    return _grid(spark, sf)


@query(
    "grid_marginals",
    f"WITH {GRID_SQL} " + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS value, count(sharpe) AS n, avg(sharpe) AS mean_sharpe, median(sharpe) AS median_sharpe, avg(ann_return) AS mean_ann_return, "
        f"avg(max_dd) AS mean_max_dd, avg(fold_sharpe_min) AS mean_fold_min FROM st GROUP BY 2" for d in G.DIMENSIONS
    ),
    "mean_sharpe median_sharpe mean_ann_return mean_max_dd mean_fold_min",
)
def grid_marginals(spark, sf):
    from ..operators.cross import marginals

    return marginals(_grid(spark, sf), G.DIMENSIONS)


@query(
    "grid_best",
    f"WITH {GRID_SQL} SELECT variant, hedge, sharpe, ann_return FROM st ORDER BY round(sharpe, 6) DESC, variant, hedge LIMIT 20",
    "sharpe ann_return",
)
def grid_best(spark, sf):
    """The twenty best cells: a top-k report."""
    g = _grid(spark, sf).withColumn("_s", F.round("sharpe", 6))
    return g.orderBy(F.desc("_s"), "variant", "hedge").limit(20).select("variant", "hedge", "sharpe", "ann_return")


EVAL = f"""{X.FINAL}, {X.BENCH},
cal AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM px)),
det AS (SELECT f.date AS signal_date, nd AS evaluation_date, f.ticker, final_weight, p0.price AS start_price, p1.price AS end_price,
  CASE WHEN f.ticker = 'CASH' THEN 0.0 ELSE p1.price/p0.price - 1 END AS r FROM fin f JOIN cal ON cal.date = f.date AND nd IS NOT NULL
  LEFT JOIN px p0 ON p0.date = f.date AND p0.ticker = f.ticker LEFT JOIN px p1 ON p1.date = nd AND p1.ticker = f.ticker),
per AS (SELECT 'blend' AS model_name, signal_date, evaluation_date, coalesce(sum(final_weight*r), 0) AS portfolio_return, count(*) FILTER (ticker <> 'CASH') AS holding_count,
  coalesce(sum(final_weight) FILTER (ticker = 'CASH'), 0) AS cash_weight,
  coalesce(arg_min(ticker, (-r, ticker)) FILTER (r IS NOT NULL AND ticker <> 'CASH'), 'NONE') AS best_ticker, max(r) FILTER (ticker <> 'CASH') AS best_holding_return,
  coalesce(arg_min(ticker, (r, ticker)) FILTER (r IS NOT NULL AND ticker <> 'CASH'), 'NONE') AS worst_ticker, min(r) FILTER (ticker <> 'CASH') AS worst_holding_return,
  coalesce(string_agg(CASE WHEN r IS NULL THEN ticker END, ', ' ORDER BY ticker), '') AS missing_tickers FROM det GROUP BY ALL),
perf AS (SELECT p.*, b1.price/b0.price - 1 AS bench_return, portfolio_return - (b1.price/b0.price - 1) AS excess_return, portfolio_return - (b1.price/b0.price - 1) > 0 AS beat_bench
FROM per p LEFT JOIN bench b0 ON b0.date = signal_date LEFT JOIN bench b1 ON b1.date = evaluation_date)"""


def period_evaluation_of(spark, sf):
    read = X.sums(spark, sf)
    signals = final_portfolio_of(spark, sf, read).select(
        F.lit("blend").alias("model_name"), F.col("date").alias("signal_date"), "ticker", "final_weight"
    )
    return perf.evaluate_periods(
        stage(signals, "signals"), A.with_price(read), X.bench(spark, sf, read)
    )[0].drop("signal_price_date")


@query(
    "period_evaluation", f"WITH {EVAL} SELECT * FROM perf",
    "portfolio_return cash_weight best_holding_return worst_holding_return bench_return excess_return",
)
def period_evaluation(spark, sf):
    return period_evaluation_of(spark, sf)


@query(
    "cumulative_performance",
    f"""WITH {EVAL}, c AS (SELECT model_name, signal_date, 100000*product(1+portfolio_return) OVER w AS portfolio_value, 100000*product(1+bench_return) OVER w AS bench_value FROM perf
WINDOW w AS (PARTITION BY model_name ORDER BY signal_date ROWS UNBOUNDED PRECEDING))
SELECT model_name, signal_date, portfolio_value/100000 - 1 AS portfolio_cum_return, bench_value/100000 - 1 AS bench_cum_return, portfolio_value/100000 - bench_value/100000 AS cum_excess_return,
portfolio_value/max(portfolio_value) OVER (PARTITION BY model_name ORDER BY signal_date ROWS UNBOUNDED PRECEDING) - 1 AS portfolio_drawdown FROM c""",
    "portfolio_cum_return bench_cum_return cum_excess_return portfolio_drawdown",
)
def cumulative_performance(spark, sf):
    out = perf.cumulative(period_evaluation_of(spark, sf), 100000.0)
    return out.select(
        "model_name", "signal_date", "portfolio_cum_return", "bench_cum_return", "cum_excess_return", "portfolio_drawdown"
    )


@query(
    "overlapping_baskets",
    f"""WITH {X.BOOK}, live AS (SELECT date AS formed, ticker, last_day(date + to_months(i::INT)) AS date FROM book CROSS JOIN range(1, 7) t(i)),
b AS (SELECT l.date, formed, avg(ret_1m) AS r FROM live l JOIN feat f ON f.date = l.date AND f.ticker = l.ticker GROUP BY 1, 2 HAVING avg(ret_1m) IS NOT NULL)
SELECT date, avg(r) AS ret, count(*) AS live_baskets FROM b GROUP BY 1""",
    "ret",
)
def overlapping_baskets(spark, sf):
    f = _features(spark, sf)
    return extras.overlapping_baskets(X.book(f), f, 6)


@query(
    "sector_share_by_year",
    f"""WITH {X.BOOK} SELECT year(date) AS year, sector, count(*) AS picks, count(*)/sum(count(*)) OVER (PARTITION BY year(date))::DOUBLE AS share
FROM book JOIN uni USING (ticker) GROUP BY 1, 2""",
    "share",
)
def sector_share_by_year(spark, sf):
    return extras.sector_share_by_year(X.book(X.feat(spark, sf)), A.universe(spark, sf))


@query(
    "most_picked",
    f"WITH {X.BOOK} SELECT ticker, count(*) AS times_picked FROM book GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def most_picked(spark, sf):
    """The ten most frequent picks: a top-k report."""
    return extras.most_picked(X.book(X.feat(spark, sf)), 10)


_STRESS = f"""{X.FEAT},
banned AS (SELECT ticker FROM (SELECT ticker, row_number() OVER (PARTITION BY date ORDER BY ret_6m DESC, ticker) AS r FROM feat WHERE ret_6m IS NOT NULL) WHERE r <= 20 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
{X.basket_sql('s5', 'ret_6m', 5)}, {X.basket_sql('s10', 'ret_6m', 10)}, {X.basket_sql('s20', 'ret_6m', 20)},
nb AS (SELECT * FROM feat WHERE ticker NOT IN (SELECT ticker FROM banned)), {X.basket_sql('sb', 'ret_6m', 20, 'nb')},
vb AS (SELECT 'top5' AS variant, date, ticker, branch_inner_weight AS weight FROM s5 UNION ALL SELECT 'top10', date, ticker, branch_inner_weight FROM s10
UNION ALL SELECT 'top20', date, ticker, branch_inner_weight FROM s20 UNION ALL SELECT 'no_favourites', date, ticker, branch_inner_weight FROM sb),
held AS (SELECT b.*, future_1m_return AS ret FROM vb b LEFT JOIN feat f ON f.date = b.date AND f.ticker = b.ticker), {turnover_sql('held', 'variant')},
costs AS (SELECT variant, c AS cost_rate, date, gross_return - turnover*c AS ret FROM net CROSS JOIN (VALUES (0.001::DOUBLE), (0.005), (0.02)) t(c)),
periods AS (SELECT variant, cost_rate, 'all' AS period, date, ret FROM costs UNION ALL SELECT variant, cost_rate, 'without_last_year', date, ret FROM costs WHERE year(date) < (SELECT max(year(date)) FROM costs))"""


@query(
    "stress_tables",
    f"WITH {_STRESS} SELECT variant, cost_rate, period, months, ann_return, sharpe, max_dd FROM ({stats_sql('periods', 'variant, cost_rate, period', None)})",
    "cost_rate ann_return sharpe max_dd",
)
def stress_tables(spark, sf):
    """Basket sizes and a ban on the most picked names, at three cost levels, with and without the last year."""
    from ..operators.cross import excluding

    f = _features(spark, sf)
    favourites = extras.most_picked(X.book(f, n=20), 3)
    books = [X.book(f, n=n).withColumn("variant", F.lit(f"top{n}")) for n in (5, 10, 20)]
    books.append(X.book(excluding(f, favourites, ["ticker"]), n=20).withColumn("variant", F.lit("no_favourites")))
    held = stage(perf.attach_returns(reduce(DataFrame.unionByName, books), f), "held")
    net = stage(perf.net_returns(held, by=["variant"]), "net")
    rates = net.withColumn("cost_rate", F.explode(F.array(*[F.lit(c) for c in (0.001, 0.005, 0.02)])))
    ret = rates.select("variant", "cost_rate", "date", (F.col("gross_return") - F.col("turnover") * F.col("cost_rate")).alias("ret"))
    last = net.select(F.max(F.year("date"))).scalar()
    periods = ret.withColumn(
        "period", F.explode(F.when(F.year("date") < last, F.array(F.lit("all"), F.lit("without_last_year"))).otherwise(F.array(F.lit("all"))))
    )
    return perf.summarize(periods, ["variant", "cost_rate", "period"]).select(
        "variant", "cost_rate", "period", "months", "ann_return", "sharpe", "max_dd"
    )
