"""Comparing two versions of a dataset, and checking that tables are up to date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import correlation, ratio
from .construct import CASH
from .cross import column_profile, table_profiles
from .medians import exact_medians
from .shape import month_end


def price_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per common ticker: months in both, spans, and absolute relative differences of b against a."""
    am, bm = month_end(a), month_end(b)

    # months that both tables know at all: spans are taken there, of each table's own prices
    dates = am.select("date").distinct().join(bm.select("date").distinct(), "date")

    def span(df, side):
        known = df.filter(F.col("price").isNotNull()).join(dates, "date", "left_semi")
        return known.groupBy("ticker").agg(F.min("date").alias(f"{side}_first_date"), F.max("date").alias(f"{side}_last_date"))

    both = am.withColumnRenamed("price", "_a").join(bm.withColumnRenamed("price", "_b"), ["ticker", "date"])
    usable = both.filter(F.col("_a") != 0).withColumn("_d", F.abs(ratio(F.col("_b") - F.col("_a"), "_a")))
    # one ticker has at most one row per month, so the built-in median sees a bounded group
    stats = usable.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("overlap_count"),
        F.avg("_d").alias("mean_abs_pct_diff"),
        F.median("_d").alias("median_abs_pct_diff"),
        F.max("_d").alias("max_abs_pct_diff"),
        F.max_by("_a", "date").alias("latest_a_price"),
        F.max_by("_b", "date").alias("latest_b_price"),
        F.max_by("_d", "date").alias("latest_abs_pct_diff"),
    )
    stats = stats.join(span(am, "a"), "ticker").join(span(bm, "b"), "ticker")  # a ticker without overlap has no spans
    common = am.select("ticker").distinct().join(bm.select("ticker").distinct(), "ticker")
    return common.join(stats, "ticker", "left").withColumn("overlap_count", F.coalesce("overlap_count", F.lit(0)))


def large_diffs(diff: DataFrame, limit: float = 0.05) -> DataFrame:
    return diff.filter(F.col("latest_abs_pct_diff") > limit)


def one_sided(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found in only one of the two tables."""
    ka, kb = a.select(*keys).distinct(), b.select(*keys).distinct()
    return (
        ka.join(kb, keys, "left_anti").withColumn("side", F.lit("a"))
        .unionByName(kb.join(ka, keys, "left_anti").withColumn("side", F.lit("b")))
    )


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every column of either table: where it is, its types and its missing shares (one aggregate per table)."""
    spark = a.sparkSession

    def side(df: DataFrame, s: str) -> DataFrame:
        shares = df.agg(
            *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]
        ).unpivot([], df.columns, "column", f"{s}_missing_share")
        types = spark.createDataFrame(
            [(f.name, f.dataType.simpleString()) for f in df.schema.fields], f"column string, {s}_type string"
        )
        return types.join(shares, "column").withColumn(f"in_{s}", F.lit(True))

    return (
        side(a, "a").join(side(b, "b"), "column", "full_outer")
        .withColumn("in_a", F.coalesce("in_a", F.lit(False)))
        .withColumn("in_b", F.coalesce("in_b", F.lit(False)))
    )


def value_diff(a: DataFrame, b: DataFrame, features: list[str]) -> DataFrame:
    """Per feature, how far b is from a on the newest date both have, over the tickers both have there."""
    dates = a.select("date").intersect(b.select("date"))
    newest = dates.select(F.max("date")).scalar()
    la = a.filter(F.col("date") == newest).select("ticker", *[F.col(c).alias(f"a_{c}") for c in features])
    lb = b.filter(F.col("date") == newest).select("ticker", *[F.col(c).alias(f"b_{c}") for c in features])
    both = la.join(lb, "ticker")
    diffs = both.select(
        *[F.abs(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(c) for c in features],
        *[F.col(f"{s}_{c}") for s in "ab" for c in features],
    )
    row = diffs.agg(
        *[
            F.struct(
                F.count(c).alias("overlap_count"),
                F.avg(c).alias("mean_abs_diff"),
                F.max(c).alias("max_abs_diff"),
                F.avg(F.col(f"a_{c}").isNull().cast("double")).alias("a_missing_share"),
                F.avg(F.col(f"b_{c}").isNull().cast("double")).alias("b_missing_share"),
            ).alias(c)
            for c in features
        ]
    ).unpivot([], features, "feature", "_s").select("feature", "_s.*")
    medians = exact_medians(diffs, features).withColumnRenamed("median", "median_abs_diff")
    return row.join(F.broadcast(medians), "feature").withColumn("comparison_date", newest)


def signal_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Weights of two signals side by side, with membership flags; a missing weight is zero."""
    wa = a.select("ticker", F.col("final_weight").alias("a_weight"))
    wb = b.select("ticker", F.col("final_weight").alias("b_weight"))
    zero = F.lit(0.0)
    return (
        wa.join(wb, "ticker", "full_outer")
        .withColumn("a_weight", F.coalesce("a_weight", zero))
        .withColumn("b_weight", F.coalesce("b_weight", zero))
        .withColumn("in_a", F.col("a_weight") > 0)
        .withColumn("in_b", F.col("b_weight") > 0)
        .withColumn("in_both", F.col("in_a") & F.col("in_b"))
        .withColumn("weight_diff", F.col("b_weight") - F.col("a_weight"))
        .withColumn("abs_weight_diff", F.abs("weight_diff"))
    )


def signal_diff_summary(diff: DataFrame) -> DataFrame:
    stock = F.col("ticker") != CASH
    a, b = stock & F.col("in_a"), stock & F.col("in_b")
    s = diff.agg(
        F.count_if(a).alias("a_count"),
        F.count_if(b).alias("b_count"),
        F.count_if(a & b).alias("overlap_count"),
        F.count_if(a & ~b).alias("only_a_count"),
        F.count_if(b & ~a).alias("only_b_count"),
        correlation("a_weight", "b_weight").alias("weight_correlation"),
        F.sum("abs_weight_diff").alias("total_abs_weight_diff"),
        F.coalesce(F.sum(F.when(~stock, F.col("a_weight"))), F.lit(0.0)).alias("a_cash_weight"),
        F.coalesce(F.sum(F.when(~stock, F.col("b_weight"))), F.lit(0.0)).alias("b_cash_weight"),
    )
    return s.withColumn("overlap_share_of_a", ratio("overlap_count", "a_count")).withColumn(
        "overlap_share_of_b", ratio("overlap_count", "b_count")
    )


def signal_lists(a: DataFrame, b: DataFrame, top: int = 10) -> DataFrame:
    """One row: date and model of both signals, tickers in both, in one only, and each side's ``top`` by weight. A signal
    names one portfolio, so its tickers fit a list."""
    cols = ["ticker", "final_weight", "signal_date", "model_name"]
    both = a.select(F.lit("a").alias("_s"), *cols).unionByName(b.select(F.lit("b").alias("_s"), *cols))
    here = {s: F.col("_s") == s for s in "ab"}
    stock = F.col("ticker") != CASH
    row = both.agg(
        *[F.max(F.when(here[s], F.col("signal_date"))).alias(f"{s}_signal_date") for s in "ab"],
        *[F.min(F.when(here[s], F.col("model_name"))).alias(f"{s}_model_name") for s in "ab"],
        *[F.collect_set(F.when(here[s] & stock, F.col("ticker"))).alias(f"_{s}") for s in "ab"],
        *[F.collect_list(F.when(here[s] & stock, F.struct((-F.col("final_weight")).alias("w"), "ticker"))).alias(f"_{s}_w") for s in "ab"],
    )
    text = lambda array: F.array_join(F.array_sort(array), ", ")
    return row.select(
        *[f"{s}_{c}" for c in ("signal_date", "model_name") for s in "ab"],
        text(F.array_intersect("_a", "_b")).alias("overlap_tickers"),
        text(F.array_except("_a", "_b")).alias("only_a_tickers"),
        text(F.array_except("_b", "_a")).alias("only_b_tickers"),
        *[
            F.array_join(F.transform(F.slice(F.sort_array(f"_{s}_w"), 1, top), lambda x: x["ticker"]), ", ").alias(f"{s}_top_tickers")
            for s in "ab"
        ],
    )


def freshness(tables: dict[str, DataFrame], as_of: dt.date, max_age_days: int = 45) -> DataFrame:
    """Which tables lag behind: base and neighbors against prices, signals against neighbors and prices.

    ``tables`` has the keys prices, base, neighbors and signals; a missing one is an issue (signals: no finding)."""
    profiles = table_profiles(tables)
    row = profiles.agg(
        *[F.max(F.when(F.col("name") == n, F.col("max_date"))).alias(f"{n}_date") for n in ("prices", "base", "neighbors", "signals")]
    )
    p, base, near, sig = (F.col(f"{n}_date") for n in ("prices", "base", "neighbors", "signals"))
    age = F.datediff(F.lit(as_of), p)

    def one(cond):
        return F.coalesce(cond, F.lit(False)).cast("bigint")

    issues = one(p.isNull()) + one(near.isNull()) + one(base.isNull())
    warnings = one(near < p) + one(base < p) + one(sig < near) + one(sig < p) + one(age > max_age_days)
    return row.select(
        "*",
        age.cast("bigint").alias("stale_days"),
        issues.alias("issue_count"),
        warnings.alias("warning_count"),
        (issues == 0).alias("ready"),
        F.array_join(
            F.array_compact(
                F.array(
                    F.when(one(near < p) == 1, "neighbors behind prices"),
                    F.when(one(base < p) == 1, "base behind prices"),
                    F.when(one(sig < near) == 1, "signals behind neighbors"),
                    F.when(one(sig < p) == 1, "signals behind prices"),
                    F.when(one(age > max_age_days) == 1, "prices stale"),
                )
            ),
            "; ",
        ).alias("warnings"),
    )


__all__ = [
    "price_diff", "large_diffs", "one_sided", "schema_diff", "value_diff", "signal_diff", "signal_diff_summary",
    "freshness", "column_profile",
]
