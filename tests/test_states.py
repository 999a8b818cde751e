"""States by batch against the whole table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelweave.operators import states as S
from panelweave.plans.staging import new_path

BY, COLUMNS = ["date", "g"], ["x", "y"]


def table(spark):
    rows = [(dt.date(2020, 1 + i % 6, 1), "ab"[i % 2], i, float(i % 7) if i % 5 else None, float("nan") if i % 3 else 2.0 * i) for i in range(120)]
    return spark.createDataFrame(rows, "date date, g string, i int, x double, y double").cache()


def same(got, rows):
    want = rows.groupBy(*BY).agg(*[f(F.nanvl(c, F.lit(None).cast("double"))).alias(f"{c}_{k}") for c in COLUMNS for k, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp))])
    key = lambda r: (r.date, r.g)
    a, b = sorted(got.collect(), key=key), sorted(want.select(got.columns).collect(), key=key)
    assert [tuple(r)[:2] for r in a] == [tuple(r)[:2] for r in b]
    for x, y in zip(a, b):
        assert tuple(x)[2:] == pytest.approx(tuple(y)[2:], abs=1e-9)


def test_increments_and_a_correction(spark):
    df, path = table(spark), new_path(spark, "states")
    months = [S.update(df.filter(F.month("date") <= m), path, BY, COLUMNS).count() for m in (2, 4, 4, 6, 6)]
    assert months == [2, 2, 0, 2, 0]
    same(S.merged(spark, path, BY, COLUMNS), df)
    hit = (F.month("date") == 3) & (F.col("i") % 4 == 0)
    fixed = df.withColumn("x", F.when(hit, F.lit(50.0)).otherwise(F.col("x"))).filter(~hit | (F.col("i") % 8 == 0))
    S.correct(df.filter(hit), fixed.filter(hit), path, BY, COLUMNS)
    same(S.merged(spark, path, BY, COLUMNS), fixed)
    into = new_path(spark, "states")
    S.compacted(spark, path, into, BY)
    same(S.merged(spark, into, BY, COLUMNS), fixed)
    assert spark.read.parquet(into).count() == spark.read.parquet(path).select(*BY).distinct().count()


def test_a_group_that_is_taken_out_is_gone(spark):
    df, path = table(spark), new_path(spark, "states")
    S.update(df, path, BY, COLUMNS)
    gone = df.filter("g = 'a'")
    S.correct(gone, gone.limit(0), path, BY, COLUMNS)
    same(S.merged(spark, path, BY, COLUMNS), df.filter("g = 'b'"))
    assert S.update(df, path, BY, COLUMNS).count() == 0
