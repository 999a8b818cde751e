"""Panels derived from the star-schema tables: the price, universe, macro, quote and latent inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import month_end
from .schemas import EVENTS


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str):
    """Money as whole cents: integer sums are exact in any order, so results do not depend on partitioning."""
    return F.round(F.col(c) * 100).cast("bigint")


def _unit_price():
    return (
        F.sum(cents("l_extendedprice")).cast("double") / (F.sum(F.col("l_quantity").cast("bigint")) * 100).cast("double")
    )


def monthly_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, cents, qty): one row per supplier and month; map-side sums absorb hot suppliers."""
    return (
        load(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", month_end("l_shipdate").alias("date"))
        .agg(
            F.sum(cents("l_extendedprice")).alias("cents"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        )
        .select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), "date", "cents", "qty")
    )


def with_price(sums: DataFrame) -> DataFrame:
    return sums.select(
        "ticker", "date", (F.col("cents").cast("double") / (F.col("qty") * 100).cast("double")).alias("price")
    )


def monthly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_price(monthly_sums(spark, sf_dir))


def benchmark_from(sums: DataFrame) -> DataFrame:
    """(date, price) of everything together, from the per-ticker sums."""
    return sums.groupBy("date").agg(
        (F.sum("cents").cast("double") / (F.sum("qty") * 100).cast("double")).alias("price")
    )


def net_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second price source: the same lines net of discount, without the returned ones."""
    return (
        load(spark, sf_dir, "lineitem")
        .filter(F.col("l_returnflag") != "R")
        .groupBy("l_suppkey", month_end("l_shipdate").alias("date"))
        .agg(
            (
                F.sum(cents("l_extendedprice") * (100 - cents("l_discount"))).cast("double")
                / (F.sum(F.col("l_quantity").cast("bigint")) * 10000).cast("double")
            ).alias("price")
        )
        .select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), "date", "price")
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"),
            F.col("s_name").alias("company"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
        )
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, close, high, low, volume) by brand and ship date."""
    lines = load(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity"
    )
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        lines.join(load(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.upper("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date"))
        .agg(
            _unit_price().alias("close"),
            F.max(unit).alias("high"),
            F.min(unit).alias("low"),
            F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("volume"),
        )
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, series, value): daily mean by event type."""
    return (
        load(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("series"))
        .agg((F.sum(cents("value")).cast("double") / (F.count("value") * 100).cast("double")).alias("value"))
    )


def line_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, series, value): daily unit price of the lines of each line number and of each return flag."""
    lines = load(spark, sf_dir, "lineitem")
    return (
        lines.select(F.to_date("l_shipdate").alias("date"), F.explode(F.array(F.concat(F.lit("L"), "l_linenumber"), F.col("l_returnflag"))).alias("series"), "l_extendedprice", "l_quantity")
        .groupBy("date", "series")
        .agg((F.sum(cents("l_extendedprice")).cast("double") / (F.sum(F.col("l_quantity").cast("bigint")) * 100).cast("double")).alias("value"))
    )


def ticks(df: DataFrame) -> DataFrame:
    """Events as quotes; ``ts`` becomes a zoned timestamp, which watermarks need."""
    return df.select(
        F.concat(F.lit("U"), F.col("user_id")).alias("ticker"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id"),
        F.col("event_type").alias("series"),
        F.col("value").alias("price"),
    )


def quote_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(load(spark, sf_dir, "events"))


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(
        spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )


def event_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings to value against the quotes: one share per order of the customer with the same number."""
    return (
        load(spark, sf_dir, "orders")
        .groupBy(F.concat(F.lit("U"), F.col("o_custkey")).alias("ticker"))
        .agg(
            F.count("*").cast("double").alias("shares"),
            (F.sum(cents("o_totalprice")).cast("double") / (F.count("*") * 100)).alias("avg_entry_price"),
        )
    )


PERIODS = 40  # of the vectors: a calendar does not grow with the number of keys


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a period and an outcome; the newest period's outcome is not known yet."""
    e = load(spark, sf_dir, "embeddings")
    period = F.pmod(F.col("vec_id"), F.lit(PERIODS)).cast("bigint")
    outcome = F.when(period < PERIODS - 1, F.col("label") - 4.5)
    return e.select(
        F.col("vec_id").cast("bigint").alias("ticker"),
        period.alias("date"),
        F.col("embedding").cast("array<double>").alias("z"),
        outcome.alias("future_1m_return"),
        (outcome - 0.5).alias("future_1m_excess_return"),
    )
