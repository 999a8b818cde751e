"""Latent states of every date from the rows before it, all dates in a fixed number of jobs.

What a scaler and principal components need to know of the rows is their number, the sums of the features and the sums of their
products. These are added up per date, carried along time by one running sum for each pair of features, and turned into a
small eigenproblem for each date, in tasks. A row is then transformed by the model of its own date, which has seen strictly
earlier dates only. A missing value counts as 0, whatever the other rows hold, so nothing later can show through it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import finite
from ..plans.staging import stage

PART_ROWS = 1 << 16  # rows that are transformed together


def product_sums(rows: DataFrame, features: list[str], date: str = "date") -> DataFrame:
    """(date, i, j, total): sums of the products of features i <= j of each date, where number 0 is the constant one."""
    p = len(features) + 1
    at = [(i, j) for i in range(p) for j in range(i, p)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        type_of_date = None
        for batch in batches:
            days, type_of_date = batch.column(date).to_pylist(), batch.column(date).type
            x = np.column_stack([np.ones(len(days)), *[batch.column(c).to_numpy(zero_copy_only=False) for c in features]])
            for day in set(days):
                own = x[[d == day for d in days]]
                sums[day] = sums.get(day, 0.0) + own.T @ own
        i, j = np.array(at, np.int32).T
        for day, total in sums.items():
            yield pa.record_batch([pa.array([day] * len(at), type_of_date), pa.array(i), pa.array(j), pa.array(total[i, j])], names=[date, "i", "j", "total"])

    kind = rows.schema[date].dataType.simpleString()
    filled = rows.select(date, *[F.coalesce(finite(c), F.lit(0.0)).alias(c) for c in features])
    partial = filled.mapInArrow(run, f"{date} {kind}, i int, j int, total double")
    return partial.groupBy(date, "i", "j").agg(F.sum("total").alias("total"))


def solve(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, loadings [p, k], shares [k]) from the sums of products; a feature that does not vary has scale 1 and no loading."""
    n = total[0, 0]
    mean = total[0, 1:] / n
    cov = (total[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    flat = spread <= 1e-12 * np.maximum(np.abs(mean), 1e-300)
    scale = np.where(flat, 1.0, spread)
    corr = cov / np.outer(scale, scale)
    corr[flat] = corr[:, flat] = 0.0
    values, vectors = np.linalg.eigh(corr)
    order = np.argsort(-values, kind="stable")[:k]
    loadings = vectors[:, order]
    loadings *= np.where(np.take_along_axis(loadings, np.abs(loadings).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)  # one sign, not two
    return mean, scale, loadings, np.maximum(values[order], 0) / max(len(mean) - flat.sum(), 1)


def models_by_date(rows: DataFrame, features: list[str], k: int, least: int = 250, date: str = "date") -> DataFrame:
    """(date, n, mean, scale, loadings, shares) of every date with at least ``least`` rows before it, of which there are n."""
    p, k = len(features), min(k, len(features))
    before = Window.partitionBy("i", "j").orderBy(date).rowsBetween(Window.unboundedPreceding, -1)  # one row for each date
    carried = product_sums(rows, features, date).withColumn("total", F.sum("total").over(before)).filter("total IS NOT NULL")

    def fit(group: pa.Table) -> pa.Table:
        total = np.zeros((p + 1, p + 1))
        i, j, value = (group.column(c).to_numpy() for c in ("i", "j", "total"))
        total[i, j] = total[j, i] = value
        n = int(round(total[0, 0]))
        some = n >= least
        arrays = [a.tobytes() for a in solve(total, k)] if some else [None] * 4
        cut = group.column(date)[: int(some)]
        columns = [cut, pa.array([n] * len(cut), pa.int64()), *[pa.array([a] * len(cut), pa.binary()) for a in arrays]]
        return pa.table(columns, names=[date, "n", "mean", "scale", "loadings", "shares"])

    kind = rows.schema[date].dataType.simpleString()
    return carried.groupBy(date).applyInArrow(fit, f"{date} {kind}, n bigint, mean binary, scale binary, loadings binary, shares binary")


def transformed(rows: DataFrame, models: DataFrame, features: list[str], key: str = "ticker", date: str = "date", by: str = "date") -> DataFrame:
    """``rows`` (key, date and features) with z and reconstruction_error under the model of the date in column ``by``, or under those
    of all dates where ``by`` is an array; a date that has no model gives no row. A row is sent once, however many models it meets."""
    if dict(rows.dtypes)[by].startswith("array"):
        return _transformed_by_all(rows, models, features, key, date, by)
    most = rows.groupBy(by).count().agg(F.max("count")).first()[0] or 1
    parts = -(-most // PART_ROWS)
    kinds, p = dict(rows.dtypes), len(features)
    arrays = ("mean", "scale", "loadings")
    sent = models.select(
        F.col(date).alias("_by"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), F.lit(0).alias("_kind"), *arrays
    )
    held = rows.select(
        F.col(by).alias("_by"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("_part"), F.lit(1).alias("_kind"),
        F.col(key).alias("_key"), F.col(date).alias("_date"), F.array(*[F.coalesce(finite(c), F.lit(0.0)) for c in features]).alias("_x"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, model = None, None
        for batch in batches:
            group = list(zip(batch.column("_by").to_pylist(), batch.column("_part").to_pylist(), batch.column("_kind").to_pylist(), strict=True))
            edges = [0, *[i for i in range(1, len(group)) if group[i] != group[i - 1]], len(group)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                *at, kind = group[lo]
                if at != name:
                    name, model = at, None
                if kind == 0:
                    mean, scale, loadings = (np.frombuffer(batch.column(c)[lo].as_buffer()) for c in arrays)
                    model = mean, scale, loadings.reshape(p, -1)
                elif model:
                    own = batch.slice(lo, hi - lo)
                    s = (own.column("_x").flatten().to_numpy().reshape(-1, p) - model[0]) / model[1]
                    z = s @ model[2]
                    error = np.maximum((s * s).sum(axis=1) - (z * z).sum(axis=1), 0.0) / p
                    columns = [own.column("_key"), own.column("_date"), own.column("_by"), pa.array(list(z), pa.list_(pa.float64())), pa.array(error)]
                    yield pa.record_batch(columns, names=[key, date, "model_date", "z", "reconstruction_error"])

    met = sent.unionByName(held, allowMissingColumns=True).repartition("_by", "_part").sortWithinPartitions("_by", "_part", "_kind")
    schema = f"{key} {kinds[key]}, {date} {kinds[date]}, model_date {kinds[by]}, z array<double>, reconstruction_error double"
    return met.mapInArrow(run, schema)


def _transformed_by_all(rows: DataFrame, models: DataFrame, features: list[str], key: str, date: str, by: str) -> DataFrame:
    """A task gets every model, one for each date of a calendar, ahead of a part of the rows."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))
    kinds, p = dict(rows.dtypes), len(features)
    arrays = ("mean", "scale", "loadings")
    sent = models.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), F.lit(0).alias("_kind"), F.array(date).alias("_by"), *arrays
    )
    held = rows.select(
        F.pmod(F.xxhash64(key, date), F.lit(parts)).cast("int").alias("_part"), F.lit(1).alias("_kind"), F.col(by).alias("_by"),
        F.col(key).alias("_key"), F.col(date).alias("_date"), F.array(*[F.coalesce(finite(c), F.lit(0.0)) for c in features]).alias("_x"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        part = None
        for batch in batches:
            at = batch.column("_part").to_numpy()
            kind = batch.column("_kind").to_numpy()
            change = np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *change], [*change, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if at[lo] != part:
                    part, known = at[lo], {}
                own = batch.slice(lo, hi - lo)
                lists = own.column("_by")
                if kind[lo] == 0:
                    for r, day in enumerate(lists.flatten().to_pylist()):
                        mean, scale, loadings = (np.frombuffer(own.column(c)[r].as_buffer()) for c in arrays)
                        known[day] = mean, scale, loadings.reshape(p, -1)
                    continue
                x = own.column("_x").flatten().to_numpy().reshape(-1, p)
                row = np.repeat(np.arange(len(own)), lists.value_lengths().fill_null(0).to_numpy())
                asked = lists.flatten().dictionary_encode()
                code = asked.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")
                edges = np.searchsorted(code[order], np.arange(len(asked.dictionary) + 1))
                for c, day in enumerate(asked.dictionary.to_pylist()):
                    if day not in known:
                        continue
                    mean, scale, loadings = known[day]
                    of = row[order[edges[c] : edges[c + 1]]]
                    s = (x[of] - mean) / scale
                    z = s @ loadings
                    error = np.maximum((s * s).sum(axis=1) - (z * z).sum(axis=1), 0.0) / p
                    sizes = np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)
                    taken = own.select(["_key", "_date"]).take(pa.array(of))
                    made = [*taken.columns, pa.repeat(asked.dictionary[c], len(of)), pa.ListArray.from_arrays(sizes, z.ravel()), pa.array(error)]
                    yield pa.record_batch(made, names=[key, date, "model_date", "z", "reconstruction_error"])

    met = sent.unionByName(held, allowMissingColumns=True).repartitionById(parts, "_part").sortWithinPartitions("_part", "_kind")
    model_date = dict(models.dtypes)[date]
    schema = f"{key} {kinds[key]}, {date} {kinds[date]}, model_date {model_date}, z array<double>, reconstruction_error double"
    return met.mapInArrow(run, schema)


def latents_by_date(rows: DataFrame, features: list[str], k: int = 16, least: int = 250) -> DataFrame:
    """(ticker, date, model_date, z, reconstruction_error) of every row that has a model of its date."""
    return transformed(rows, stage(models_by_date(rows, features, k, least), "date-models"), features)


FLAT = 1e-12  # of the first component's variance: a component that does not vary but for rounding


def judged(rows: DataFrame, n: int, by: str = "model_date") -> DataFrame:
    """(by, uncorrelated, falling): whether the first ``n`` components z are uncorrelated and fall in variance. A component that does
    not vary, as where few features do, is uncorrelated with any and may come last only."""
    z = [F.get("z", F.lit(i)) for i in range(n)]
    sums = rows.groupBy(by).agg(
        *[F.variance(c).alias(f"v{i}") for i, c in enumerate(z)], *[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(zip(z, z[1:]))]
    )
    flat = [F.col(f"v{i}") <= FLAT * F.col("v0") for i in range(n)]
    alone = [flat[i + 1] | (F.abs(f"c{i}") < 1e-6 * F.sqrt(F.col(f"v{i}") * F.col(f"v{i + 1}"))) for i in range(n - 1)]
    fall = [flat[i + 1] | (~flat[i] & (F.col(f"v{i}") >= F.col(f"v{i + 1}"))) for i in range(n - 1)]
    both = lambda a, b: a & b
    return sums.select(by, reduce(both, alone).alias("uncorrelated"), reduce(both, fall).alias("falling"))
