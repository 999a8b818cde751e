"""Latent state of each row: impute, standardise, principal components, clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.staging import stage
from .medians import impute


def state_matrix(df: DataFrame, features: list[str], as_of=None) -> DataFrame:
    """Numeric inputs without gaps, next to the keys."""
    return impute(df, features, as_of)


def with_vector(df: DataFrame, features: list[str], out: str = "x") -> DataFrame:
    """Feature columns as one vector column."""
    return VectorAssembler(inputCols=features, outputCol=out).transform(df)


@dataclass
class LatentModel:
    scaler: object
    pca: object
    features: list[str]

    def scaler_table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(f, float(m), float(s)) for f, m, s in zip(self.features, self.scaler.mean, self.scaler.std)],
            "feature string, mean double, scale double",
        )

    def variance(self, spark) -> DataFrame:
        share = [float(v) for v in self.pca.explainedVariance]
        rows = [(i + 1, f"z{i + 1}", v) for i, v in enumerate(share)]
        df = spark.createDataFrame(rows, "position int, component string, explained_variance_ratio double")
        upto = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("cumulative_explained_variance", F.sum("explained_variance_ratio").over(upto))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the scaled inputs (x_scaled), the components z as an array, and the reconstruction error.

        The components are orthonormal, so what they leave of a row is its squared length minus theirs: no
        matrix has to be shipped to a Python worker."""
        out = self.pca.transform(self.scaler.transform(df))
        arrays = out.withColumn("_s", vector_to_array("x_scaled")).withColumn("z", vector_to_array("_z"))
        error = (_square_sum("_s") - _square_sum("z")) / F.size("_s")
        return arrays.withColumn("reconstruction_error", F.greatest(error, F.lit(0.0))).drop("_z", "_s", "x_scaled", "x")


def _square_sum(c: str) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v * v)


def fit_latents(df: DataFrame, features: list[str], k: int = 16, before=None, date: str = "date") -> LatentModel:
    """Scaler and principal components of the vector column x. ``before`` fits on strictly earlier rows only."""
    train = df if before is None else df.filter(F.col(date) < before)
    scaler = StandardScaler(inputCol="x", outputCol="x_scaled", withMean=True, withStd=True).fit(train)
    pca = PCA(k=min(k, len(features)), inputCol="x_scaled", outputCol="_z").fit(scaler.transform(train))
    return LatentModel(scaler, pca, features)


def prefix(df: DataFrame, dim: int, vec: str = "z") -> DataFrame:
    """The first ``dim`` components: components are nested, so one fit serves every smaller dimension."""
    return df.withColumn(vec, F.slice(vec, 1, dim))


def flat_components(df: DataFrame, k: int, vec: str = "z") -> DataFrame:
    return df.select(*[c for c in df.columns if c != vec], *[F.get(vec, F.lit(i)).alias(f"z{i + 1}") for i in range(k)])


def cluster(
    df: DataFrame, k: int = 4, seed: int = 42, vec: str = "z", iterations: int = 300, starts: int = 10
) -> DataFrame:
    """Cluster label and the distance to every centre (an array in centre order), from the best of ``starts`` fits."""
    data = stage(df, "cluster-input")
    v = data.withColumn("_v", array_to_vector(vec))
    fits = [
        KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="cluster", maxIter=iterations).fit(v) for i in range(starts)
    ]
    model = min(fits, key=lambda m: m.summary.trainingCost)
    centres = [[float(x) for x in c] for c in model.clusterCenters()]

    def to_centre(c: list[float]) -> Column:
        gaps = F.zip_with(vec, F.array(*[F.lit(x) for x in c]), lambda a, b: (a - b) * (a - b))
        return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g))

    return model.transform(v).drop("_v").withColumn("dist_cluster", F.array(*[to_centre(c) for c in centres]))


def sweep(df: DataFrame, features: list[str], dims: tuple[int, ...] = (4, 8, 16, 32), before=None) -> dict[int, DataFrame]:
    """One fit at the largest dimension; every smaller one is a prefix of it."""
    full = stage(fit_latents(df, features, max(dims), before).transform(df), "latent-sweep")
    return {d: prefix(full, d) for d in dims}
