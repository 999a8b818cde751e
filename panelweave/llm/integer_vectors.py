"""Vectors as exact integers: floor(scale * x) of every component."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE = 256
LARGEST = 1 << 26  # of an integer component: products over 2,048 components stay below 2**63


def integer_vectors(
    rows: DataFrame, id_column: str = "vec_id", label: str | Column = "label", vector: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(vec_id bigint, label bigint, v array<int>): rows with a vector that is not null and holds finite numbers only.

    An empty vector has nothing to compare and takes no part. A component beyond ``LARGEST`` ends the job with an error
    that says so, as sums over it need not fit a long. Other columns of ``rows`` are ignored."""
    inf = float("inf")
    clean = rows.select(
        F.col(f"`{id_column}`").cast("bigint").alias("vec_id"),
        (F.col(f"`{label}`") if isinstance(label, str) else label).cast("bigint").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("x"),
    )
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf))
    kept = clean.filter(F.col("x").isNotNull() & (F.size("x") > 0) & finite)
    fits = F.forall("x", lambda c: F.abs(c * scale) < LARGEST)
    whole = F.transform("x", lambda c: F.floor(c * scale).cast("int"))
    return kept.select(
        "vec_id", "label", F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component exceeds {LARGEST} / {scale}"))).alias("v")
    )


def matrix(column: pa.Array, dim: int):
    """The rows of an array<int> column of one length as [rows, dim] int64."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("int64")
