"""Connected components of an edge table by alternating stars. Every round is written to the shared folder; the number
of rounds grows with the logarithm of the largest component, and the edge table never grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.staging import stage


def _stars(both: DataFrame, small: bool) -> DataFrame:
    """Edges (a, b), in both directions, to edges between each node's neighbours and the least of them."""
    near = both.filter("b <= a") if small else both
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = near.join(least, "a")
    kept = moved if small else moved.filter("b > a")
    out = kept.select(F.col("b").alias("hi"), F.col("m").alias("lo"))
    if small:
        out = out.unionAll(least.select(F.col("a").alias("hi"), F.col("m").alias("lo")))
    return out.filter("hi <> lo").distinct()


def _mirrored(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionAll(
        edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component): links (a, b) to the smallest node that each node reaches. Nodes without a link are absent.

    Null ends and loops are ignored; repeated links count once; an empty table gives an empty table."""
    edges = stage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    seen = None
    while True:
        edges = stage(_stars(_mirrored(edges), small=False), "stars")
        edges = stage(_stars(_mirrored(edges), small=True), "stars")
        state = edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")),
            F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")),
        ).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
