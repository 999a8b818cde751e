"""Hand-made frames with hand-computed answers, one per rule that is easy to get wrong."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.functions import scalars as S
from panelweave.functions.feature_names import check_no_leak, feature_columns, numbered_columns
from panelweave.functions.rolling import Rolling
from panelweave.operators import book as B, compare as Q, construct as C, features as feats, medians, perf, ranks, shape

MONTHS = [d.date() for d in pd.date_range("2020-01-31", periods=14, freq="ME")]


def rows(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.fixture(scope="module")
def gappy(spark):
    """One key, 14 months; the first and the sixth price are missing."""
    prices = [None, 10.0, 11.0, 12.0, 13.0, None, 14.0, 15.0, 16.0, 17.0, 18.0, 19.0, 20.0, 21.0]
    return rows(spark, [("A", d, p) for d, p in zip(MONTHS, prices)], "ticker string, date date, price double")


def test_rolling_needs_all_values(gappy):
    t = Rolling()
    ma = column(gappy.select("date", t.mean("price", 3).alias("v")), "v")
    assert ma[:3] == [None, None, None] and ma[3] == pytest.approx(11.0)
    assert ma[5:8] == [None, None, None] and ma[8] == pytest.approx(15.0)


def test_returns_do_not_bridge_gaps_unless_padded(gappy):
    plain = column(shape.simple_returns(gappy), "ret")
    padded = column(shape.simple_returns(gappy, fill="pad"), "ret")
    assert plain[5] is None and plain[6] is None
    assert padded[5] == pytest.approx(0.0) and padded[6] == pytest.approx(14 / 13 - 1)


def test_unknown_excess_counts_as_not_outperforming(spark):
    f = rows(spark, [(MONTHS[0], "A", None), (MONTHS[0], "B", 0.5)], "date date, ticker string, future_1m_return double")
    bench = rows(spark, [(d, 10.0 + i) for i, d in enumerate(MONTHS[:3])], "date date, price double")
    out = {r.ticker: r.target_outperform_1m for r in feats.with_benchmark(f, bench).collect()}
    assert out == {"A": 0.0, "B": 1.0}


@pytest.mark.parametrize("n", [7, 11])
def test_fifths_are_not_ntile(spark, n):
    df = rows(spark, [(MONTHS[0], f"T{i:02d}", float(i)) for i in range(n)], "date date, ticker string, future_1m_return double")
    got = column(ranks.fifths(df), "ranking_label", "ticker")
    expect = pd.cut(pd.Series(range(n)).rank(method="first", pct=True), [0, 0.2, 0.4, 0.6, 0.8, 1.0], labels=False, include_lowest=True)
    assert got == list(expect)


def test_equal_values_rank_by_ticker(spark):
    df = rows(spark, [(MONTHS[0], t, 1.0) for t in "CAB"], "date date, ticker string, ranker_score double")
    assert column(ranks.score_rank(df), "rank_by_date", "ticker") == [1, 2, 3]


def test_split_ranks_equal_plain_ranks_with_heavy_ties(spark):
    rng = np.random.default_rng(1)
    data = [(MONTHS[i % 2], f"T{i:04d}", float(rng.integers(0, 4))) for i in range(600)]
    df = rows(spark, data, "date date, ticker string, ranker_score double")
    plain = ranks.score_rank(df).select("date", "ticker", "rank_by_date")
    split = ranks.score_rank(df, task_rows=20).select("date", "ticker", "rank_by_date")
    assert plain.exceptAll(split).count() == 0 and split.count() == 600


def test_moments_match_pandas(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=30)
    df = rows(spark, [("A", i, float(v)) for i, v in enumerate(x)], "ticker string, date int, r double")
    t = Rolling()
    out = df.select("date", t.skew("r", 10).alias("s"), t.kurt("r", 10).alias("k"))
    s = pd.Series(x)
    assert column(out, "s")[9:] == pytest.approx(list(s.rolling(10).skew()[9:]))
    assert column(out, "k")[9:] == pytest.approx(list(s.rolling(10).kurt()[9:]))


def test_correlation_of_a_constant_is_unknown(spark):
    df = rows(spark, [("A", i, 1.0, float(i)) for i in range(5)], "ticker string, date int, a double, b double")
    assert column(df.select("date", Rolling().corr("a", "b", 3).alias("c")), "c") == [None] * 5


def test_first_loss_is_no_drawdown(spark):
    df = rows(spark, [(1, MONTHS[0], -0.5), (1, MONTHS[1], 0.1)], "series_id int, date date, ret double")
    assert perf.summarize(df, ["series_id"]).first().max_dd == pytest.approx(0.0)


def test_statistics_at_the_edges(spark):
    data = [("flat", 0.01), ("flat", 0.01), ("one", 0.02), ("bust", -1.0), ("bust", 0.3)]
    df = rows(spark, [(n, MONTHS[i], r) for i, (n, r) in enumerate(data)], "series_id string, date date, ret double")
    out = {r.series_id: r for r in perf.summarize(df, ["series_id"]).collect()}
    assert out["flat"].sharpe is None and out["flat"].sortino == math.inf
    assert out["one"].ann_vol is None and out["one"].sharpe is None and out["one"].sortino is None
    assert out["bust"].ann_return == -1.0 and out["bust"].max_dd is None  # the curve starts at zero


def test_inverse_vol_uses_the_basket_median(spark):
    data = [("d1", "A", 0.1), ("d1", "B", 0.2), ("d1", "C", 0.0), ("d1", "D", None), ("d2", "A", None), ("d2", "B", 0.0)]
    df = rows(spark, data, "date string, ticker string, vol_12m double")
    w = {(r.date, r.ticker): r.branch_inner_weight for r in C.inverse_vol(df, ["date"]).collect()}
    total = 10 + 5 + 7.5 + 7.5
    assert [w["d1", t] for t in "ABCD"] == pytest.approx([10 / total, 5 / total, 7.5 / total, 7.5 / total])
    assert w["d2", "A"] == w["d2", "B"] == 0.5


def test_regime_off_holds_cash(spark):
    p = rows(spark, [(MONTHS[0], "A", 0.6), (MONTHS[0], "B", 0.4), (MONTHS[1], "A", 1.0)],
             "date date, ticker string, final_weight_before_regime double").withColumn("branches", F.lit("x"))
    regime = rows(spark, [(MONTHS[0], -0.3, False, 0.5), (MONTHS[1], 0.0, True, 0.5)],
                  "date date, regime_drawdown double, risk_on boolean, cash_weight_when_off double")
    out = {(r.date, r.ticker): r.final_weight for r in C.apply_regime(p, regime).collect()}
    assert out == pytest.approx({(MONTHS[0], "A"): 0.3, (MONTHS[0], "B"): 0.2, (MONTHS[0], "CASH"): 0.5, (MONTHS[1], "A"): 1.0})
    plain, _ = C.build_portfolio([(p.select("date", "ticker", F.lit(0.2).alias("vol_12m"), F.lit(1.0).alias("ranker_score")), C.Branch("b", 5, 1.0))], None)
    assert plain.filter("ticker = 'CASH'").count() == 0


def test_dip_tilt_takes_a_ratio_near_one(spark):
    b = rows(spark, [("d", "A", 0.5, 0.9), ("d", "B", 0.5, None)], "date string, ticker string, weight double, ratio_to_ma double")
    out = {r.ticker: r.tilted_weight for r in C.dip_tilt(b).collect()}
    assert out == pytest.approx({"A": 1.1 / 2.1, "B": 1.0 / 2.1})


def test_turnover_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    book, loop, prev = [], [], None
    for d in MONTHS[:6]:
        names = rng.choice(list("ABCDEFGHIJ"), 4, replace=False)
        w, r = rng.dirichlet(np.ones(4)), rng.normal(0, 0.1, 4)
        book += [(d, str(n), float(a), float(b)) for n, a, b in zip(names, w, r)]
        target = dict(zip(names, w))
        keys = set(target) | set(prev or {})
        loop.append(sum(abs(target.get(k, 0) - (prev or {}).get(k, 0)) for k in keys))
        grown = {n: a * (1 + b) for n, a, b in zip(names, w, r)}
        prev = {n: g / sum(grown.values()) for n, g in grown.items()}
    df = rows(spark, book, "date date, ticker string, weight double, ret double")
    assert column(perf.turnover(df), "turnover") == pytest.approx(loop)
    with_cash = df.withColumn("weight", F.col("weight") * 0.5).unionByName(
        df.select("date").distinct().select("date", F.lit("CASH").alias("ticker"), F.lit(0.5).alias("weight"), F.lit(0.0).alias("ret"))
    )
    assert column(perf.turnover(with_cash), "turnover")[0] == pytest.approx(0.5)


def test_missing_return_keeps_its_weight_visible(spark):
    df = rows(spark, [(MONTHS[0], "A", 0.5, 0.1), (MONTHS[0], "B", 0.3, None), (MONTHS[0], "CASH", 0.2, 0.0)],
              "date date, ticker string, weight double, ret double")
    r = perf.gross_returns(df).first()
    assert (r.gross_return, r.n_positions, r.cash_weight, r.missing_return_weight) == pytest.approx((0.05, 2, 0.2, 0.3))


PRICES = [(MONTHS[0], "A", 10.0), (MONTHS[0], "B", 0.0), (MONTHS[0], "C", None), (MONTHS[0], "D", 7.0)]


def test_order_sheet_types_and_cash(spark):
    prices = rows(spark, PRICES, "date date, ticker string, price double")
    w = rows(spark, [("A", 0.55), ("B", 0.1), ("C", 0.1), ("X", 0.05), ("CASH", 0.2)], "ticker string, final_weight double")
    out = {r.ticker: r for r in B.order_sheet(w, prices, MONTHS[0], 1000.0).collect()}
    kinds = {t: r.order_type for t, r in out.items()}
    assert kinds == {"A": "BUY_TO_TARGET", "B": "BAD_PRICE", "C": "BAD_PRICE", "X": "MISSING_PRICE", "CASH": "HOLD_CASH"}
    assert out["A"].rounded_shares == 55.0 and out["A"].leftover_cash_from_rounding == pytest.approx(250.0)
    held = B.initial_holdings(B.order_sheet(w, prices, MONTHS[0], 1000.0))
    assert held.agg(F.sum("market_value")).first()[0] == pytest.approx(1000.0)
    assert held.agg(F.sum("current_weight")).first()[0] == pytest.approx(1.0)


def test_mark_to_market_policies(spark):
    prices = rows(spark, PRICES, "date date, ticker string, price double")
    h = rows(spark, [("A", 2.0, 9.0), ("X", 3.0, 4.0), ("CASH", 5.0, 1.0)], "ticker string, shares double, last_price double")
    kept = {r.ticker: r.market_value for r in B.mark_to_market(h, prices, MONTHS[1]).collect()}
    null = {r.ticker: r.market_value for r in B.mark_to_market(h, prices, MONTHS[1], "null").collect()}
    assert kept == {"A": 20.0, "X": 12.0, "CASH": 5.0} and null == {"A": 20.0, "X": None, "CASH": 5.0}


def test_rebalance_rounds_toward_zero(spark):
    prices = rows(spark, PRICES, "date date, ticker string, price double")
    m = rows(spark, [("A", 9.0, 90.0), ("D", 0.0, 0.0), ("CASH", 10.0, 10.0)], "ticker string, shares double, market_value double")
    t = rows(spark, [("A", 0.55), ("D", 0.40), ("CASH", 0.05)], "ticker string, final_weight double")
    out = {r.ticker: r for r in B.rebalance_orders(m, t, prices, MONTHS[0]).collect()}
    assert (out["A"].action, out["A"].trade_shares) == ("SELL", -3.0)  # -3.5 stops short
    assert (out["D"].action, out["D"].trade_shares) == ("BUY", 5.0)
    assert out["CASH"].action == "CASH_ADJUST" and out["CASH"].trade_shares == pytest.approx(-5.0)


def test_numbers_dates_and_ratios_never_raise(spark):
    df = rows(spark, [("1.5", "2020-01-31"), ("x", "01/31/2020"), ("NaN", "20200131"), ("Infinity", "never")], "n string, d string")
    out = df.select(S.to_number("n").alias("n"), S.to_day("d").alias("d"), S.ratio(F.lit(1.0), F.lit(0.0)).alias("q")).collect()
    assert [r.n for r in out] == [1.5, None, None, None]
    assert [r.d for r in out] == [dt.date(2020, 1, 31)] * 3 + [None] and out[0].q is None


def test_infinite_values_take_the_median(spark):
    df = rows(spark, [(1.0,), (3.0,), (float("inf"),), (None,)], "x double")
    assert sorted(r.x for r in medians.impute(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]


def test_medians_by_brackets_are_exact(spark):
    rng = np.random.default_rng(4)
    a = np.round(rng.normal(size=5000), 2)
    b = np.where(rng.random(5000) < 0.6, 0.0, rng.normal(size=5000))  # one value holds most rows
    df = rows(spark, [(float(x), float(y), None) for x, y in zip(a, b)], "a double, b double, c double")
    got = {r.feature: r.median for r in medians.exact_medians(df, ["a", "b", "c"], 5).collect()}
    assert got == {"a": np.median(a), "b": np.median(b), "c": None}


def test_feature_sets_are_numeric_and_leak_free(spark):
    df = rows(spark, [], "date date, ticker string, sector string, price double, ret_1m double, neighbor_count bigint, "
                         "v3_x double, future_1m_return double, target_y int, ranking_label int")
    assert feature_columns(df, "original_only") == ["ret_1m", "v3_x"]
    assert feature_columns(df, "base_only") == ["ret_1m"]
    assert feature_columns(df, "original_only", prices=True) == ["price", "ret_1m", "v3_x"]
    assert feature_columns(df) == ["ret_1m", "v3_x", "neighbor_count"]
    with pytest.raises(ValueError):
        check_no_leak(["ret_1m", "Future_thing"])
    assert numbered_columns(["z10", "z2", "zz", "z1"], "z") == ["z1", "z2", "z10"]


def test_asof_takes_the_last_row_even_if_its_value_is_missing(spark):
    left = rows(spark, [("A", dt.date(2020, 1, 31))], "ticker string, date date")
    right = rows(spark, [("A", dt.date(2020, 1, 20), 1.0), ("A", dt.date(2020, 1, 30), None), ("A", dt.date(2020, 2, 1), 9.0)],
                 "ticker string, date date, price double")
    r = shape.asof_join(left, right, ["ticker"], matched_as="found").first()
    assert r.found == dt.date(2020, 1, 30) and r.price is None


def test_features_do_not_change_when_the_future_is_cut_off(spark):
    rng = np.random.default_rng(5)
    data = [(t, d, float(100 * np.exp(rng.normal()))) for t in "ABC" for d in MONTHS]
    grid = rows(spark, data, "ticker string, date date, price double")
    past = [c for c in feats.stock_features(grid).columns if not c.startswith("future")]
    full = feats.stock_features(grid).filter(F.col("date") <= MONTHS[9]).select(*past)
    cut = feats.stock_features(grid.filter(F.col("date") <= MONTHS[9])).select(*past)
    assert full.exceptAll(cut).count() == 0 and cut.exceptAll(full).count() == 0


def test_rank_buffer_holds_between_the_limits(spark):
    seq = [1, 30, 41, 30, 20, None]
    df = rows(spark, [("A", MONTHS[i], r) for i, r in enumerate(seq)], "ticker string, date date, rank_by_date bigint")
    assert column(C.rank_buffer(df), "held") == [True, True, False, False, True, False]


def test_vol_target_looks_back_only(spark):
    r = [0.1, -0.1, 0.1, -0.1, 0.1, -0.1, 5.0]
    df = rows(spark, [(1, MONTHS[i], v) for i, v in enumerate(r)], "series_id int, date date, ret double")
    got = column(C.vol_target(df), "exposure")
    assert got[:6] == [1.0] * 6 and got[6] == pytest.approx(0.15 / (np.std(r[:6], ddof=1) * 12**0.5))


def test_no_snapshot_without_any_quote(spark):
    schema = "ticker string, shares double, current_price double, previous_close double, quote_status string"
    held = rows(spark, [("A", 2.0, None, None, None), ("CASH", 5.0, 1.0, 1.0, "cash")], schema)
    quotes = held.select("ticker", "current_price", "previous_close", "quote_status")
    detail = B.value_positions(held.select("ticker", "shares"), quotes)
    assert B.value_snapshot(detail).count() == 0
    cash_only = detail.filter("ticker = 'CASH'")
    assert B.value_snapshot(cash_only).first().current_value == 5.0
    priced = B.value_positions(held.select("ticker", "shares"), quotes.na.fill({"current_price": 3.0}))
    assert B.value_snapshot(priced).first().current_value == 11.0


def test_signal_lists(spark):
    schema = "ticker string, final_weight double, signal_date date, model_name string"
    a = rows(spark, [("A", 0.2, MONTHS[0], "m"), ("B", 0.7, MONTHS[0], "m"), ("CASH", 0.1, MONTHS[0], "m")], schema)
    b = rows(spark, [("B", 0.5, MONTHS[1], "n"), ("C", 0.5, MONTHS[1], "n")], schema)
    got = Q.signal_lists(a, b, top=1).first()
    assert tuple(got) == (MONTHS[0], MONTHS[1], "m", "n", "B", "A", "C", "B", "B")


def test_scores_that_are_missing_rank_last(spark):
    data = [(MONTHS[0], "A", None), (MONTHS[0], "B", float("nan")), (MONTHS[0], "C", -1.0), (MONTHS[0], "D", 2.0)]
    out = ranks.score_rank(rows(spark, data, "date date, ticker string, ranker_score double"))
    assert {r.ticker: r.rank_by_date for r in out.collect()} == {"D": 1, "C": 2, "A": 3, "B": 4}


def test_dates_without_an_exposure_stay_invested(spark):
    book = rows(spark, [(MONTHS[0], "A", 1.0), (MONTHS[1], "A", 1.0)], "date date, ticker string, weight double")
    exposures = rows(spark, [(MONTHS[0], "trend", 0.4)], "date date, hedge string, exposure double")
    out = {(r.date, r.hedge): r.weight for r in C.hedged(book, exposures).collect()}
    assert len(out) == 2 * len(C.HEDGES)
    assert out.pop((MONTHS[0], "trend")) == 0.4 and set(out.values()) == {1.0}


def test_indicators_of_many_values(spark):
    df = rows(spark, [(i, f"v{i}") for i in range(1200)] + [(5000, None)], "id long, industry string")
    wide = feats.indicator_columns(df, ["industry"], {"industry": ["v1", "v2"]})
    assert wide.columns == ["id", "industry", "industry_v1", "industry_v2"]
    assert {r.id for r in wide.collect() if r.industry_v2} == {2}
    long = feats.indicator_rows(df, ["id"], ["industry"])
    assert long.count() == 1200 and long.filter("id = 7").first().indicator == "industry_v7"
    assert len(feats.indicator_columns(df.limit(3), ["industry"]).columns) == 5


def test_price_spans_cover_common_dates_only(spark):
    schema = "ticker string, date date, price double"
    a = rows(spark, [("A", MONTHS[0], 1.0), ("A", MONTHS[1], 2.0), ("B", MONTHS[0], 1.0), ("A", MONTHS[2], 4.0)], schema)
    b = rows(spark, [("A", MONTHS[1], 3.0), ("B", MONTHS[1], 1.0), ("A", MONTHS[2], 4.0), ("A", MONTHS[5], 9.0)], schema)
    got = {r.ticker: r for r in Q.price_diff(a, b).collect()}
    assert (got["A"].a_first_date, got["A"].b_last_date, got["A"].overlap_count) == (MONTHS[1], MONTHS[2], 2)
    assert (got["B"].overlap_count, got["B"].a_first_date, got["B"].b_last_date) == (0, None, None)


@pytest.mark.parametrize("kind", ["date", "timestamp"])
def test_asof_scan_equals_a_search(spark, kind):
    import bisect
    import random

    from panelweave.operators.shape import asof_scan

    rng = random.Random(4)
    unit = dt.timedelta(days=1) if kind == "date" else dt.timedelta(minutes=7)
    start = dt.date(2020, 1, 1) if kind == "date" else dt.datetime(2020, 1, 1, 9)
    right = [(start + unit * i, float(i) if i % 5 else None) for i in sorted(rng.sample(range(3000), 120))]
    left = [(start + unit * rng.randrange(-50, 3100), i) for i in range(200)] + [(right[3][0], 999)]
    got = asof_scan(spark.createDataFrame(left, f"date {kind}, i int"), spark.createDataFrame(right, f"date {kind}, v double"), matched_as="hit")
    days = [d for d, _ in right]
    for r in got.collect():
        at = bisect.bisect_right(days, r.date) - 1
        assert (r.hit, r.v) == (right[at] if at >= 0 else (None, None))
    assert got.count() == 201
    empty = spark.createDataFrame([], f"date {kind}, v double")
    assert asof_scan(spark.createDataFrame(left, f"date {kind}, i int"), empty).filter("v IS NULL").count() == 201


def test_positions_follow_the_order(spark):
    from panelweave.operators.shape import with_position

    df = spark.createDataFrame([(i * 7 % 101, f"t{i:03d}") for i in range(101)], "a int, ticker string")
    got = {r.ticker: r.position for r in with_position(df, [F.col("a") % 3, F.col("ticker")]).collect()}
    order = sorted(((i * 7 % 101) % 3, f"t{i:03d}") for i in range(101))
    assert [got[t] for _, t in order] == list(range(1, 102))


def test_medians_of_odd_columns(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1e-300, 50), rng.normal(0, 1e300, 51), [-0.0, 0.0, 5e-324, -5e-324]])
    data = [(float(v), None, float(i % 2), int(i), float("nan") if i % 3 else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "a double, b double, c double, d int, e double")
    got = {r.feature: r.median for r in medians.exact_medians(df, list("abcde")).collect()}
    e = [v for i, v in enumerate(x) if i % 3 == 0]
    assert got == {"a": np.median(x), "b": None, "c": np.median([i % 2 for i in range(len(x))]), "d": np.median(range(len(x))), "e": np.median(e)}
    assert {r.median for r in medians.exact_medians(df.limit(0), ["a"]).collect()} == {None}
