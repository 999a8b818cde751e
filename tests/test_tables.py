"""Reading, writing, ledgers and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paths import SMALL
from panelweave.catalog import QUERIES
from panelweave.plans.grid import variants
from panelweave.plans.staging import new_path, pick
from panelweave.sources import adapters as A, ledgers as L, schemas, tables as T
from panelweave.streaming.period_close import close_months, closed_days
from panelweave.streaming.quote_state import run_quote_state, state_quotes
from panelweave.streaming.valuation import all_quotes, day_snapshots, last_quotes, merge_quotes, run_valuation

D = dt.date


def test_wide_panel_round_trip(spark):
    path = new_path(spark, "wide")
    wide = spark.createDataFrame([(D(2020, 1, 31), 1.0, None), (D(2020, 2, 29), 2.0, float("nan"))], "date date, ` aa ` double, Bb double")
    T.write_table(wide, path)
    got = {(r.date, r.ticker): r.price for r in T.read_price_panel(spark, path).collect()}
    assert got == {(D(2020, 1, 31), "AA"): 1.0, (D(2020, 1, 31), "BB"): None, (D(2020, 2, 29), "AA"): 2.0, (D(2020, 2, 29), "BB"): None}
    both = T.read_ohlcv(spark, {"close": path, "volume": path})
    assert set(both.columns) == {"date", "ticker", "close", "volume"} and both.count() == 4


def test_feature_table_is_pruned_and_typed(spark):
    path = new_path(spark, "features")
    spark.createDataFrame([("2020-01-31", " a ", float("inf"), 1.0)], "date string, ticker string, x double, unused_column double").write.parquet(path)
    df = T.read_features(spark, path, ["date", "ticker", "x"])
    assert df.first() == (D(2020, 1, 31), "A", None)
    assert "unused_column" not in df._jdf.queryExecution().executedPlan().toString()


def test_universe_defaults_and_first_row(spark):
    path = new_path(spark, "universe")
    T.write_table(spark.createDataFrame([("b ", "x", None), ("B", "y", "Tech"), ("a", None, "")], "ticker string, company string, sector string").coalesce(1), path, "csv")
    got = {r.ticker: tuple(r)[1:] for r in T.read_universe(spark, path).collect()}
    assert got == {"B": ("x", "Unknown", "Unknown"), "A": ("A", "Unknown", "Unknown")}


def test_ledger_reads_messy_text(spark):
    path = new_path(spark, "ledger")
    raw = [("m", "2020-01-31", "aa", "0.5"), ("m", "01/31/2020", "bb", "bad")]
    spark.createDataFrame(raw, "model_name string, signal_date string, ticker string, final_weight string").coalesce(1).write.option("header", True).csv(path)
    out = {r.ticker: r for r in T.read_ledger(spark, path, schemas.SIGNALS).collect()}
    assert out["AA"].final_weight == 0.5 and out["BB"].final_weight is None
    assert out["BB"].signal_date == D(2020, 1, 31) and out["AA"].best_rank is None


def test_missing_table_is_an_empty_typed_frame(spark):
    df = T.read_or_empty(spark, new_path(spark, "nothing"), schemas.HOLDINGS)
    assert df.count() == 0 and df.schema == schemas.HOLDINGS


def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([("m", 1, "A"), ("m", 2, "B"), ("n", 2, "C")], "model string, day int, ticker string")
    new = spark.createDataFrame([("m", 2, "X", "extra")], "model string, day int, ticker string, note string")
    once = L.upsert(old, new, ["model", "day"])
    twice = L.upsert(once, new, ["model", "day"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    assert {(r.model, r.day, r.ticker) for r in once.collect()} == {("m", 1, "A"), ("n", 2, "C"), ("m", 2, "X")}


def test_partition_upsert_keeps_other_days(spark):
    path = new_path(spark, "snap")
    L.upsert_partitions(spark.createDataFrame([(1, 10.0), (2, 20.0)], "day int, v double"), path, ["day"])
    L.upsert_partitions(spark.createDataFrame([(2, 21.0)], "day int, v double"), path, ["day"])
    assert {(r.day, r.v) for r in spark.read.parquet(path).collect()} == {(1, 10.0), (2, 21.0)}


def test_latest_and_pending(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "model string, day int, t string")
    assert [r.t for r in L.latest_partition(df, "day", F.col("model") == "b").collect()] == ["z"]
    assert {(r.model, r.t) for r in L.latest_row(df, ["model"], "day").collect()} == {("a", "y"), ("b", "z")}
    assert sorted(r.day for r in L.pending(df.select("day"), df.filter("day = 2").select("day"), "day").collect()) == [1, 3]


def test_pick_takes_the_rows_that_are_asked_for(spark):
    df = spark.range(100).filter("id >= 0")
    assert pick(df, spark.range(5), ["id"]).count() == 5


def test_grid_has_the_full_number_of_constructions(spark):
    v = variants(spark, ["a", "b"], [10, 20, 25, 35], ["4", "8", "16", "32"], [5, 10, 20], [(0.7, 0.3), (0.5, 0.5)])
    assert v.count() == 8 + 8 * 12 * 2 + 12 and v.select("variant").distinct().count() == 212


def test_weights_sum_to_one_on_every_date(spark):
    out = QUERIES["final_portfolio"](spark, SMALL).groupBy("date").agg(F.sum("final_weight").alias("w")).collect()
    assert out and all(r.w == pytest.approx(1.0, abs=1e-4) for r in out)


def test_closed_days_equal_batch(spark):
    stream = QUERIES["stream_closed_days"](spark, SMALL)
    ticks = A.quote_ticks(spark, SMALL)
    batch = ticks.groupBy(F.to_date("ts").alias("date"), "series").agg(
        F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.count("*").alias("ticks"))
    closed = batch.filter(F.col("date") < batch.select(F.max("date")).scalar())
    cols = ["date", "series", "price", "ticks"]
    assert stream.select(*cols).exceptAll(closed.select(*cols)).count() == 0 and stream.count() == closed.count()
    assert closed_days(A.tick_stream(spark, SMALL)).isStreaming


def _split_stream(spark):
    """The quotes in several files, one for each micro-batch."""
    folder = new_path(spark, "split-events")
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(4, "event_id").write.parquet(folder)
    return A.ticks(spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder))


def test_quotes_are_the_same_after_a_replay_of_several_batches(spark):
    path, want = new_path(spark, "quotes"), None
    for _ in range(2):  # the second time the checkpoint is lost and every batch comes again
        run_valuation(_split_stream(spark), path, new_path(spark, "check"))
        assert spark.read.parquet(path).select("batch_id").distinct().count() >= 3
        got = sorted(map(tuple, all_quotes(spark, path).select("day", "ticker", "current_price").collect()))
        assert want in (None, got) and got
        want = got
    whole = last_quotes(A.quote_ticks(spark, SMALL)).select("day", "ticker", "current_price").collect()
    assert sorted(map(tuple, whole)) == want
    q = last_quotes(A.quote_ticks(spark, SMALL))
    assert merge_quotes(q.unionByName(q)).count() == q.count()


def test_snapshots_keep_cash(spark):
    q = spark.createDataFrame([(D(2020, 1, 1), "A", 10.0), (D(2020, 1, 2), "A", 12.0)], "day date, ticker string, current_price double")
    book = spark.createDataFrame([("A", 2.0), ("CASH", 100.0), ("B", 1.0)], "ticker string, shares double")
    got = {r.day: r for r in day_snapshots(q, book).collect()}
    first, second = got[D(2020, 1, 1)], got[D(2020, 1, 2)]
    assert (first.current_value, first.cash_value, first.missing_quote_count) == (120.0, 100.0, 1)
    assert (second.current_value, second.previous_close_value, second.day_pnl) == (124.0, 120.0, 4.0)


def test_months_of_closed_days(spark):
    days = spark.createDataFrame(
        [(D(2020, 1, 5), "A", 1.0), (D(2020, 1, 30), "A", 2.0), (D(2020, 2, 3), "A", 3.0)], "date date, series string, price double"
    )
    got = {(r.date, r.price) for r in close_months(days).collect()}
    assert got == {(D(2020, 1, 31), 2.0), (D(2020, 2, 29), 3.0)}


def _quotes(spark, rows, folder):
    made = spark.createDataFrame(rows, "ticker string, at string, event_id long, price double")
    made.select("ticker", F.col("at").cast("timestamp").alias("ts"), "event_id", "price").coalesce(1).write.mode("append").parquet(folder)


def test_quote_state_closes_days_and_counts_what_is_late(spark):
    inbox, out, check = (new_path(spark, n) for n in ("inbox", "out", "check"))
    stream = lambda: spark.readStream.schema("ticker string, ts timestamp, event_id long, price double").parquet(inbox)
    got = lambda: {(r.ticker, r.day.day): (r.current_price, r.quotes, r.closed) for r in state_quotes(spark, out).collect()}
    _quotes(spark, [("A", "2020-01-01 10:00:00", 1, 1.0), ("A", "2020-01-01 11:00:00", 2, 2.0), ("A", "2020-01-01 11:00:00", 1, 9.0),
                    ("A", None, 3, 5.0), (None, "2020-01-01 10:00:00", 4, 7.0)], inbox)
    assert run_quote_state(stream(), out, check) == 0
    assert got() == {("A", 1): (2.0, 3, False), (None, 1): (7.0, 1, False)}
    # an older quote of the open day counts, and changes no price that is newer; a null price stands if it is the newest
    _quotes(spark, [("A", "2020-01-01 09:00:00", 5, 3.0), ("B", "2020-01-01 00:00:01", 6, 4.0), (None, "2020-01-01 12:00:00", None, None)], inbox)
    assert run_quote_state(stream(), out, check) == 0
    assert got() == {("A", 1): (2.0, 4, False), ("B", 1): (4.0, 1, False), (None, 1): (None, 2, False)}
    _quotes(spark, [("A", "2020-01-02 09:00:00", 7, 6.0)], inbox)  # the day before closes
    assert run_quote_state(stream(), out, check) == 0
    closed = {("A", 1): (2.0, 4, True), ("B", 1): (4.0, 1, True), (None, 1): (None, 2, True)}
    assert got() == {**closed, ("A", 2): (6.0, 1, False)}
    _quotes(spark, [("A", "2020-01-01 23:00:00", 8, 99.0), ("B", "2020-01-02 23:00:00", 9, 8.0)], inbox)
    assert run_quote_state(stream(), out, check) == 1
    assert got() == {**closed, ("A", 2): (6.0, 1, False), ("B", 2): (8.0, 1, False)}
    held = spark.read.format("statestore").option("stateVarName", "newest").load(check)
    assert {r.key.ticker for r in held.select("key").collect()} == {"A", "B"} and held.count() == 2  # open days only
    # with a day of grace the same late quote still counts
    late, check = new_path(spark, "out"), new_path(spark, "check")
    assert run_quote_state(stream(), late, check, grace_days=1) == 0
    assert {(r.ticker, r.day.day): r.current_price for r in state_quotes(spark, late).collect()}[("A", 1)] == 99.0
