"""The scan that both analog searches share, against plain numpy; ranges of ranks."""

import numpy as np
import pyarrow as pa
import pytest

from panelweave.operators import analog_index as I, analog_scan as S, analogs as K, ranks


@pytest.mark.parametrize(("dims", "n", "m", "k", "grid"), [(3, 200, 300, 7, True), (8, 150, 400, 50, False), (2, 50, 30, 50, True)])
def test_best_rows_of_a_history_that_streams_past(dims, n, m, k, grid):
    rng = np.random.default_rng(1)
    z, h = (np.round(x, 1) if grid else x for x in (rng.normal(size=(n, dims)), rng.normal(size=(m, dims))))
    days, hist_days = rng.integers(0, 10, n), np.sort(rng.integers(0, 10, m))
    columns = {"id": pa.array(range(n)), "day": pa.array(days), "z": pa.array(list(z), pa.list_(pa.float64()))}
    columns |= {"most": pa.array([np.inf] * n), "visits": pa.array([[0, 1]] * n, pa.list_(pa.int32()))}
    best, cell = S.Best(pa.table(columns), k, ()), rng.integers(0, 2, m)
    for c in (0, 1):
        own = np.flatnonzero(cell == c)
        for at in range(0, len(own), 41):
            rows = own[at : at + 41]
            best.meet(c, {"z": h[rows], "day": hist_days[rows], "id": rows})
    d = np.round(np.sqrt(((z[:, None] - h[None]) ** 2).sum(axis=2)), S.DIGITS)
    for i in range(n):
        earlier = np.flatnonzero(hist_days < days[i])
        want = earlier[np.lexsort((earlier, d[i, earlier]))][:k]
        assert best.counts()[i] == len(want) and (best.found["id"][i, : len(want)] == want).all()


def test_regions_hold_every_cell_and_no_more_than_asked():
    rng = np.random.default_rng(2)
    weights = rng.integers(0, 50, 90)
    region = S.regions_of(rng.normal(size=(90, 3)), weights, 200)
    assert set(region) == set(range(region.max() + 1))
    assert all(weights[region == r].sum() <= 200 or (region == r).sum() == 1 for r in range(region.max() + 1))


def test_a_row_is_sent_once_for_a_group_however_small_the_blocks(spark):
    rows = [(f"T{i}", i // 40, [float(v) for v in np.random.default_rng(i).normal(size=2)], 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "ticker string, date bigint, z array<double>, future_1m_return double")
    found = K.nearest_earlier(df, k=3, min_history=1, pivots=3, eras=2, block_rows=5)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapCoGroups" not in plan
    whole = K.nearest_earlier(df, k=3, min_history=1)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))


def test_equal_distances_fall_to_the_same_rows_in_both_searches(spark):
    z = [[float(i % 3), float(i % 2)] for i in range(300)]  # six points, fifty copies each
    rows = [(f"T{(i * 7919) % 300:03d}", i // 100, z[i], 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "ticker string, date bigint, z array<double>, future_1m_return double").repartition(5)
    exact, found = K.nearest_earlier(df, k=9, min_history=1), I.nearest_indexed(df, k=9, min_history=1)
    assert K.recall(found, exact).first().recall == 1.0


def test_a_bound_from_a_first_search_loses_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"T{i}", i // 20, [float(v) for v in rng.normal(size=3)], 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "ticker string, date bigint, z array<double>, future_1m_return double")
    want = sorted(map(tuple, K.nearest_earlier(df, k=4, min_history=1).collect()))
    monkeypatch.setattr(K, "MANY_ROWS", 1)
    monkeypatch.setattr(K, "FIRST_PROBES", 1)
    assert sorted(map(tuple, K.nearest_earlier(df, k=4, min_history=1).collect())) == want


def test_ranges_are_not_a_task_for_every_few_rows():
    assert ranks.range_count(5_000_000, 25, 8) == ranks.SMALL_RANGES
    assert ranks.range_count(1000, 25, 8) == 40 and ranks.range_count(10, 25, 8) == 8
    assert ranks.range_count(10**10, 25, 8) == 10**10 // ranks.TASK_ROWS


def test_a_row_meets_few_bounds_of_small_ranges():
    """Spark compares a row with one bound after the other where there are up to 128 ranges."""
    assert max(ranks.range_count(n, 25, 8) for n in (10_000, 4_583_717, 36_000_000)) <= 48


def test_a_group_is_sent_no_later_history_than_it_asks(spark):
    asking = spark.createDataFrame([(0, 3, [0, 1]), (0, 5, [0]), (1, 2, [1])], "grp int, day bigint, visits array<int>")
    history = spark.createDataFrame([(10 * c + d, d, c) for c in range(3) for d in range(8)], "id bigint, day bigint, cell int")
    sent = sorted((r.grp, r.cell, r.day) for r in S.asked_history(asking, history).collect())
    assert sent == [(0, 0, d) for d in range(5)] + [(0, 1, d) for d in range(3)] + [(1, 1, d) for d in range(2)]


def test_near_rows_are_put_in_order_as_by_three_keys():
    rng = np.random.default_rng(8)
    for scale in (1.0, 1e3, 1e9):  # the last is too wide for one number
        owner, ids = rng.integers(0, 20, 500), rng.integers(0, 99, 500)
        distance = np.round(rng.integers(0, 9, 500) * scale / 7, S.DIGITS)
        assert (S._nearest_first(owner, distance, ids) == np.lexsort((ids, distance, owner))).all()
