"""Constant-cost frames against the frames that Spark evaluates row by row."""

import random

import pytest
from pyspark.sql import functions as F

from panelweave.functions.frames import Frames
from panelweave.functions.rolling import Rolling


def _panel(spark, rows=90):
    rng, made = random.Random(5), []
    for ticker, size in (("A", rows), ("B", 7), ("C", 1), ("D", rows)):
        for date in range(size):
            x = 1000.0 + rng.gauss(0, 1) if ticker != "D" else 3.0  # D does not vary
            made.append((ticker, date, None if rng.random() < 0.2 else x, None if rng.random() < 0.1 else rng.gauss(0, 1)))
    return spark.createDataFrame(made, "ticker string, date int, x double, y double")


@pytest.mark.parametrize("n, least", [(1, None), (2, None), (5, 3), (16, None), (21, 10), (63, 30)])
def test_frames_equal_row_frames(spark, n, least):
    df, slow = _panel(spark), Rolling()
    fast = Frames(df)
    one = ("mean", "max", "min", "var", "std", "skew", "kurt")
    ours = [getattr(fast, f)("x", n, least).alias(f) for f in one] + [getattr(fast, f)("x", "y", n, least).alias(f) for f in ("cov", "corr")]
    theirs = [getattr(slow, f)("x", n, least).alias(f) for f in one] + [getattr(slow, f)("x", "y", n, least).alias(f) for f in ("cov", "corr")]
    key = lambda r: (r.ticker, r.date)
    got = sorted(fast.done().select("ticker", "date", *ours).collect(), key=key)
    want = sorted(df.select("ticker", "date", *theirs).collect(), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for name in w.asDict():
            if g[name] != w[name]:
                assert g[name] is not None and w[name] is not None, (name, g, w)
                assert g[name] == pytest.approx(w[name], rel=1e-7, abs=1e-7), (name, g, w)


def test_the_plan_has_one_window_a_level(spark):
    fast = Frames(_panel(spark))
    asked = [fast.mean("x", n) for n in (21, 63, 252)] + [fast.max("y", 252)]
    plan = fast.done().select("ticker", *[c.alias(f"c{i}") for i, c in enumerate(asked)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 4 and plan.count("Exchange hashpartitioning") == 1  # three levels and the values


def test_empty_panel(spark):
    fast = Frames(_panel(spark).limit(0))
    assert fast.done().select(fast.df.ticker).count() == 0
    mean = fast.mean("x", 3)
    assert fast.done().select(mean.alias("m")).count() == 0
