"""Latents of every date against numpy on the rows before it."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelweave.catalog import modeling
from panelweave.operators import latent_dates as L
from paths import SMALL

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3)) + 2.0
    rows = [(f"T{i}", int(i // 25), *map(float, r), 5.0) for i, r in enumerate(x)]
    rows[7] = (*rows[7][:2], None, float("nan"), *rows[7][4:])
    return spark.createDataFrame(rows, "ticker string, date int, a double, b double, c double, d double"), rows


def values(rows):
    return np.array([[0.0 if v is None or v != v else v for v in r[2:]] for r in rows])


def test_every_date_is_fitted_on_the_rows_before_it(made, monkeypatch):
    monkeypatch.setattr(L, "PART_ROWS", 10)
    df, rows = made
    got = {r.ticker: r for r in L.latents_by_date(df.repartition(4), NAMES, 2, least=60).collect()}
    assert {r.date for r in got.values()} == set(range(3, 12)) and len(got) == 225
    for date in (3, 7, 11):
        past, now = values([r for r in rows if r[1] < date]), [r for r in rows if r[1] == date]
        mean, scale = past.mean(axis=0), past.std(axis=0, ddof=1)
        scale[3] = 1.0
        s = (past - mean) / scale
        _, _, vt = np.linalg.svd(s, full_matrices=False)
        want = (values(now) - mean) / scale
        z = np.array([got[r[0]].z for r in now])
        assert np.abs(z) == pytest.approx(np.abs(want @ vt[:2].T), abs=1e-8)
        error = ((want - want @ vt[:2].T @ vt[:2]) ** 2).mean(axis=1)
        assert [got[r[0]].reconstruction_error for r in now] == pytest.approx(error, abs=1e-8)


def test_later_rows_change_nothing(made):
    df, _ = made
    early = L.latents_by_date(df.filter("date <= 6"), NAMES, 3, least=60).collect()
    full = {(r.ticker, r.date): r for r in L.latents_by_date(df, NAMES, 3, least=60).collect()}
    assert len(early) == 100
    for r in early:
        assert r.z == pytest.approx(full[r.ticker, r.date].z, abs=1e-9)


def test_no_rows_and_too_few(made):
    df, _ = made
    assert L.latents_by_date(df.limit(0), NAMES, 2).count() == 0
    assert L.latents_by_date(df, NAMES, 2, least=1000).count() == 0


def test_components_that_do_not_vary_are_judged(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2)) @ np.diag([3.0, 1.0])
    x = (x - x.mean(axis=0)) @ np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2].T
    flat = [(1, [float(a), float(b), 0.0, 0.0]) for a, b in x]
    mixed = [(2, [float(a), float(a + b), 0.0, 0.0]) for a, b in x]
    rising = [(3, [float(b), float(a), 0.0, 0.0]) for a, b in x]
    df = spark.createDataFrame(flat + mixed + rising, "model_date int, z array<double>")
    got = {r.model_date: (r.uncorrelated, r.falling) for r in L.judged(df, 4).collect()}
    assert got[1] == (True, True) and not got[2][0] and got[3] == (True, False)


def test_rows_meet_the_models_of_many_dates_as_of_each(made, monkeypatch):
    monkeypatch.setattr(L, "PART_ROWS", 40)
    df, _ = made
    models = L.models_by_date(df, NAMES, 2, least=60).cache()
    asked = df.filter("date < 9").withColumn("of", F.array(F.col("date"), F.lit(5), F.lit(8), F.lit(77)))
    one = L.transformed(asked.withColumn("of", F.explode("of")), models, NAMES, by="of").collect()
    all_at_once = L.transformed(asked.repartition(5), models, NAMES, by="of").collect()
    key = lambda r: (r.ticker, r.date, r.model_date)
    assert len(one) == len(all_at_once) > 500 and {r.model_date for r in one} == {3, 4, 5, 6, 7, 8}
    for a, b in zip(sorted(one, key=key), sorted(all_at_once, key=key), strict=True):
        assert key(a) == key(b) and a.z == pytest.approx(b.z, abs=1e-12) and a.reconstruction_error == pytest.approx(b.reconstruction_error, abs=1e-12)


def test_every_date_of_the_check_is_judged(spark, monkeypatch):
    """A model that is turned at one date, which is none of the tenth ones, is found there."""
    right = L.models_by_date

    def turned(*args, **kw):
        models = right(*args, **kw)
        day = sorted(r.date for r in models.select("date").collect())[13]

        def turn(group):
            out = group.to_pylist()
            for r in out:
                v = np.frombuffer(r["loadings"]).reshape(-1, 8).copy()
                v[:, 0] += v[:, 1]
                r["loadings"] = v.tobytes() if r["date"] == day else r["loadings"]
            return pa.Table.from_pylist(out, schema=group.schema)

        return models.groupBy("date").applyInArrow(turn, models.schema)

    monkeypatch.setattr(L, "models_by_date", turned)
    rows = sorted(modeling.latents_by_date_check(spark, SMALL).collect(), key=lambda r: r.date)
    assert [i for i, r in enumerate(rows) if not r.uncorrelated] == [13]
