"""Construction grid: every combination of branch, basket size, blend and hedge as one plan keyed by variant.

Sleeves are built once per (branch, top_n) and staged; variants only reference them. All statistics are grouped
aggregates over the variant key, so a thousand variants cost one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import perf
from ..operators.construct import hedged, inverse_vol
from ..operators.ranks import top_n
from .staging import stage

# fixed values: names of the dimensions of a grid, and of its placeholders and blends below
DIMENSIONS = ["orig_feats", "orig_topn", "neigh_dim", "neigh_topn", "blend", "hedge"]


def variants(
    spark: SparkSession,
    originals: list[str], original_sizes: list[int],
    neighbors: list[str], neighbor_sizes: list[int],
    blends: list[tuple[float, float]],
) -> DataFrame:
    """Pure original, blended and pure neighbor constructions. Parameter lists are exploded, not cross-joined."""

    def lists(*named):
        df = spark.range(1)
        for name, values in named:
            df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
        return df

    none = F.lit(None)
    pair = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in blends])
    o = ("orig_feats", originals), ("orig_topn", original_sizes)
    n = ("neigh_dim", neighbors), ("neigh_topn", neighbor_sizes)
    cols = ["orig_feats", "orig_topn", "neigh_dim", "neigh_topn", "w_orig", "w_neigh"]
    pure = lists(*o).select("orig_feats", "orig_topn", none.cast("string").alias("neigh_dim"),
                            none.cast("int").alias("neigh_topn"), F.lit(1.0).alias("w_orig"), F.lit(0.0).alias("w_neigh"))
    mixed = lists(*o, *n).withColumn("_b", F.explode(pair)).select(
        *cols[:4], F.col("_b.a").alias("w_orig"), F.col("_b.b").alias("w_neigh")
    )
    other = lists(*n).select(none.cast("string").alias("orig_feats"), none.cast("int").alias("orig_topn"),
                             "neigh_dim", "neigh_topn", F.lit(0.0).alias("w_orig"), F.lit(1.0).alias("w_neigh"))
    text = [
        F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in cols[:4]
    ]
    named = pure.unionByName(mixed).unionByName(other).select(
        *text, "w_orig", "w_neigh",
        F.concat(F.round(F.col("w_orig") * 100).cast("int"), F.lit("/"), F.round(F.col("w_neigh") * 100).cast("int")).alias("blend"),
    )
    return named.withColumn("variant", F.concat_ws("|", "orig_feats", "orig_topn", "neigh_dim", "neigh_topn", "blend"))


def sleeves(rankings: DataFrame, sizes: dict[str, list[int]], vol: str = "vol_12m") -> DataFrame:
    """(branch, top_n, date, ticker, weight): inverse-volatility sleeves of every branch and size.

    ``rankings`` has branch, date, ticker, ranker_score and the volatility. The largest basket is cut first, with
    the early limit per (branch, date); the smaller ones are prefixes of it."""
    biggest = max(n for ns in sizes.values() for n in ns)
    ranked = top_n(rankings, biggest, ["branch", "date"], [F.col("ranker_score").desc(), F.col("ticker")])
    size_of = F.lit(None).cast("array<int>")
    for branch, ns in sizes.items():
        size_of = F.when(F.col("branch") == branch, F.array(*[F.lit(n) for n in ns])).otherwise(size_of)
    cut = ranked.withColumn("top_n", F.explode(size_of)).filter(F.col("rank_by_date") <= F.col("top_n"))
    return inverse_vol(cut, ["branch", "top_n", "date"], vol, "weight").select("branch", "top_n", "date", "ticker", "weight")


def books(variant_table: DataFrame, sleeve_table: DataFrame) -> DataFrame:
    """(variant, date, ticker, weight): sleeves weighted, summed per ticker and renormalised.

    A variant takes at most two sleeves; only dates on which every branch has a sleeve are kept."""
    v = variant_table
    s = sleeve_table.withColumn("top_n", F.col("top_n").cast("string"))
    legs = v.select("variant", F.col("orig_feats").alias("branch"), F.col("orig_topn").alias("top_n"), F.col("w_orig").alias("w")).unionByName(
        v.select("variant", F.col("neigh_dim").alias("branch"), F.col("neigh_topn").alias("top_n"), F.col("w_neigh").alias("w"))
    ).filter(F.col("w") > 0)
    n_branches = s.select(F.countDistinct("branch")).scalar()
    common = s.groupBy("date").agg(F.countDistinct("branch").alias("_n")).filter(F.col("_n") == n_branches).select("date")
    joined = s.join(common, "date", "left_semi").join(legs, ["branch", "top_n"])
    summed = joined.groupBy("variant", "date", "ticker").agg(F.sum(F.col("weight") * F.col("w")).alias("_w"))
    total = F.sum("_w").over(Window.partitionBy("variant", "date"))
    return summed.select("variant", "date", "ticker", F.when(total > 0, F.col("_w") / total).otherwise(F.col("_w")).alias("weight"))


def run_grid(
    variant_table: DataFrame, sleeve_table: DataFrame, exposures: DataFrame, realized: DataFrame,
    bench: DataFrame, cost_rate: float = 0.001, n_folds: int = 5,
) -> DataFrame:
    """One row of net statistics and fold Sharpe dispersion per variant and hedge."""
    held = hedged(books(variant_table, stage(sleeve_table, "sleeves")), exposures)
    held = stage(perf.attach_returns(held, realized), "grid-books")
    by = ["variant", "hedge"]
    net = perf.net_returns(held, cost_rate, by).select(*by, "date", F.col("net_return").alias("ret"))
    net = stage(net.join(bench, "date", "left"), "grid-returns")
    stats = perf.summarize(net, by, bench="bench_ret")
    folds = perf.fold_dispersion(perf.by_fold(net, n_folds, by), by)
    names = variant_table.select("variant", *DIMENSIONS[:5])
    return stats.join(folds, by).join(names, "variant")
