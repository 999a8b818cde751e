"""Closing periods on a stream: a day is emitted once the watermark has passed it, later ticks are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.shape import month_end
from ..plans.staging import new_path


def closed_days(ticks: DataFrame, key: str = "series", delay: str = "1 hour") -> DataFrame:
    """Last price per key and day. In append mode only days that are over come out: an open day is not a day."""
    return (
        ticks.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"), F.col(key))
        .agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.count(F.lit(1)).alias("ticks"))
        .select(F.to_date("w.start").alias("date"), key, "price", "ticks")
    )


def drain(closed: DataFrame, out: str, checkpoint: str) -> None:
    query = (
        closed.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def close_days(ticks: DataFrame, key: str = "series", delay: str = "1 hour") -> DataFrame:
    spark = ticks.sparkSession
    out = new_path(spark, "closed-days")
    closed = closed_days(ticks, key, delay)
    drain(closed, out, new_path(spark, "close-checkpoint"))
    return spark.read.schema(closed.schema).parquet(out)


def close_months(days: DataFrame, key: str = "series") -> DataFrame:
    """Calendar months are no fixed duration, so they are rolled up from the closed days in batch."""
    return month_end(days, key, "date", "price")
