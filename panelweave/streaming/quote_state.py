"""The newest quote of every open day as state of a stream, closed by a timer.

State holds open days only: a day's timer writes its last quotes once and clears them. A snapshot reads one row per ticker and
closed day, and what was written for the days that are still open; it never reads the ticks again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.ledgers import upsert_partitions

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "price double, us bigint, event_id bigint, quotes bigint"
QUOTES = "ticker string, day date, current_price double, us bigint, event_id bigint, quotes bigint, closed boolean"
_PARTS = ("price", "us", "event_id", "quotes")


def combined(ticks: DataFrame) -> DataFrame:
    """(ticker, day, price, us, event_id, quotes): the newest of the quotes that arrive in one Arrow batch, so that a ticker with
    a large share of all ticks sends a row for each batch and day to its state. Ticks without a time belong to no day."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pc.ScalarAggregateOptions(skip_nulls=False)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            order = pc.sort_indices(table, [("us", "ascending"), ("event_id", "ascending")], null_placement="at_start")
            made = (
                table.take(order)
                .group_by(["ticker", "day"], use_threads=False)
                .aggregate([("price", "last", whole), ("us", "last", whole), ("event_id", "last", whole), ([], "count_all")])
                .select(["ticker", "day", "price_last", "us_last", "event_id_last", "count_all"])
                .rename_columns(["ticker", "day", *_PARTS])
            )
            yield from made.to_batches()

    rows = ticks.filter("ts IS NOT NULL").select(
        "ticker", F.to_date("ts").alias("day"), "price", F.unix_micros("ts").alias("us"), F.col("event_id").cast("bigint").alias("event_id")
    )
    return rows.mapInArrow(run, f"ticker string, day date, {STATE}")


class LastQuote(StatefulProcessor):
    """Per ticker and day: newest price, its time and event, and the number of quotes so far; cleared when the day closes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best, quotes, closes = self.newest.get(), 0, None
        fresh = best is None
        if not fresh:
            best, quotes = tuple(best[:3]), best[3]
        for r in rows:
            quotes, closes = quotes + r.quotes, r.closes_ms
            own = (r.price, r.us, r.event_id)
            if best is None or self._at(own) >= self._at(best):
                best = own
        if fresh:
            self.handle.registerTimer(closes - 1)
        self.newest.update((*best, quotes))
        yield self._row(key, best, quotes, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        *best, quotes = self.newest.get()
        self.newest.clear()
        yield self._row(key, best, quotes, True)

    @staticmethod
    def _at(quote: tuple) -> tuple:
        return quote[1], quote[2] is not None, quote[2] or 0

    @staticmethod
    def _row(key, best, quotes: int, closed: bool) -> Row:
        price, us, event_id = best
        return Row(ticker=key[0], day=key[1], current_price=price, us=us, event_id=event_id, quotes=quotes, closed=closed)


def quote_updates(ticks: DataFrame, grace_days: int = 0) -> DataFrame:
    """Stream of QUOTES rows: the newest quote of each ticker and open day that a micro-batch touched, and a closed one when the
    day is over. The watermark moves on the end of the day and not on the tick: whatever arrives while its day is open
    counts, however old; a day closes with the first tick ``grace_days`` after its end, and ticks of closed days are dropped."""
    closes = F.date_add("day", 1).cast("timestamp")
    return (
        combined(ticks)
        .withColumn("closes", closes)
        .withColumn("closes_ms", F.unix_millis("closes"))
        .withWatermark("closes", f"{1 + grace_days} days")
        .groupBy("ticker", "day")
        .transformWithState(LastQuote(), QUOTES, "Update", "EventTime")
    )


def run_quote_state(ticks: DataFrame, path: str, checkpoint: str, grace_days: int = 0) -> int:
    """Take in all that has arrived and stop; the next run with the same checkpoint goes on from there. Returns how many combined
    rows (a ticker and day of one Arrow batch) came too late.

    Every micro-batch is written once, under closed, day and batch_id; a replayed batch replaces its own partitions."""
    spark = ticks.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_partitions(batch.withColumn("batch_id", F.lit(batch_id)), path, ["closed", "day", "batch_id"])

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # typed state and timers need this store; other streams keep theirs
    try:
        query = (
            quote_updates(ticks, grace_days)
            .writeStream.foreachBatch(write)
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(STORE, before)
    query.awaitTermination()
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def state_quotes(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, day, current_price, quotes, closed): the newest quote per ticker and day. Days close in order, so those after the last
    closed one are open; only their partitions are read besides the closed ones."""
    written = spark.read.schema(QUOTES + ", batch_id bigint").parquet(path)
    closed = written.filter("closed")
    last = closed.agg(F.max("day")).first()[0]
    still = written.filter(~F.col("closed"))
    if last is not None:
        still = still.filter(F.col("day") > last)
    newest = F.struct("us", "event_id", "quotes")
    merge = lambda df: df.groupBy("ticker", "day").agg(
        F.max_by("current_price", newest).alias("current_price"), F.max("quotes").alias("quotes"), F.first("closed").alias("closed")
    )
    return closed.select("ticker", "day", "current_price", "quotes", "closed").unionByName(merge(still))
