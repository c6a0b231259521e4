"""Tree ensembles, boosting and kernel features (R10-R13) and principal components."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressionModel, DecisionTreeRegressor,
                                   GBTRegressor, RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry import FEATURES, ID, TARGET
from descry.operators.linear import LinearModel, linear_svr, train_matrix
from descry.operators.blocks import Matrix, dense
from descry.operators.scaling import fit_scaler, standardize
from descry.session import cut_lineage

VECTOR = "vector"


def with_vector(m: Matrix) -> DataFrame:
    return m.df.withColumn(VECTOR, array_to_vector(F.col(FEATURES)))


def _ml(estimator, m: Matrix):
    estimator = estimator.setFeaturesCol(VECTOR).setLabelCol(TARGET)
    return estimator.fit(with_vector(train_matrix(m)))


def random_forest(m: Matrix, trees: int = 20, depth: int = 5, seed: int = 0):
    return _ml(RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed), m)


def gradient_boosting(m: Matrix, rounds: int = 20, depth: int = 3, step: float = 0.1, seed: int = 0):
    return _ml(GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed), m)


def predict_ml(m: Matrix, model) -> DataFrame:
    """(id, y, prediction) for every row."""
    return model.transform(with_vector(m)).select(ID, TARGET, "prediction")


@dataclass(frozen=True)
class Boosted:
    trees: tuple[DecisionTreeRegressionModel, ...]
    weights: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Weighted median of the trees' predictions."""
        names = []
        for i, tree in enumerate(self.trees):
            tree.setPredictionCol(f"tree_{i}")
            df = tree.transform(df)
            names.append(f"tree_{i}")
        votes = F.array_sort(F.array(*[
            F.struct(F.col(n).alias("value"), F.lit(float(w)).alias("weight"))
            for n, w in zip(names, self.weights, strict=True)]))
        half = sum(self.weights) / 2
        walk = F.aggregate(
            votes,
            F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("value")),
            lambda acc, v: F.struct(
                (acc["sum"] + v["weight"]).alias("sum"),
                F.when(acc["value"].isNull() & (acc["sum"] + v["weight"] >= half), v["value"])
                .otherwise(acc["value"]).alias("value")))
        return df.withColumn("prediction", walk["value"]).drop(*names)


def adaboost(m: Matrix, rounds: int = 10, depth: int = 3, seed: int = 0) -> Boosted:
    """AdaBoost.R2 (Drucker 1997) with linear loss: weighted trees, rows reweighted by error.

    Row weights are a column; each round writes it out, so plans do not grow.
    """
    rows = with_vector(train_matrix(m)).select(TARGET, VECTOR, F.lit(1.0).alias("weight"))
    trees, weights = [], []
    for i in range(rounds):
        tree = DecisionTreeRegressor(
            featuresCol=VECTOR, labelCol=TARGET, weightCol="weight", predictionCol="guess",
            maxDepth=depth, seed=seed + i).fit(rows)
        error = tree.transform(rows).select(
            TARGET, VECTOR, "weight", F.abs(F.col(TARGET) - F.col("guess")).alias("error"))
        worst, total, lost = error.agg(
            F.max("error"), F.sum("weight"), F.sum(F.col("weight") * F.col("error"))).first()
        if not worst:
            trees.append(tree)
            weights.append(1.0)
            break
        mean_loss = lost / worst / total
        if mean_loss >= 0.5:
            if not trees:
                trees.append(tree)
                weights.append(1.0)
            break
        beta = mean_loss / (1 - mean_loss)
        trees.append(tree)
        weights.append(log(1 / beta))
        if i + 1 < rounds:
            factor = F.pow(F.lit(beta), 1 - F.col("error") / F.lit(worst))
            scale = F.lit(1.0 / total)  # keeps the weights from vanishing
            rows = cut_lineage(error.select(
                TARGET, VECTOR, (F.col("weight") * factor * scale).alias("weight")))
    return Boosted(tuple(trees), tuple(weights))


def fourier_features(m: Matrix, components: int = 100, gamma: float | None = None,
                     seed: int = 0) -> Matrix:
    """Random Fourier features of the Gaussian kernel exp(-gamma |x - z|^2) (Rahimi, Recht 2007)."""
    width = len(m.names)
    gamma = 1.0 / width if gamma is None else gamma
    rng = np.random.default_rng(seed)
    omega = rng.normal(scale=np.sqrt(2 * gamma), size=(width, components))
    phase = rng.uniform(0, 2 * np.pi, components)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            z = np.sqrt(2.0 / components) * np.cos(dense(batch, width) @ omega + phase)
            offsets = pa.array(np.arange(0, z.size + 1, components, dtype=np.int32))
            packed = pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))
            at = batch.schema.get_field_index(FEATURES)
            yield batch.set_column(at, FEATURES, packed)

    return Matrix(m.df.mapInArrow(project, m.df.schema),
                  tuple(f"fourier_{i}" for i in range(components)))


def kernel_svr(m: Matrix, c: float = 1.0, eps: float = 0.1, components: int = 100,
               gamma: float | None = None, seed: int = 0) -> tuple[Matrix, LinearModel]:
    """Support-vector regression on Fourier features; returns the features and the model."""
    features = fourier_features(m, components, gamma, seed)
    return features, linear_svr(features, c, eps, tol=1e-2)


def pca(df: DataFrame, names: Sequence[str], k: int = 100) -> Matrix:
    """Scores of the first min(k, columns, rows - 1) components of the columns standardised
    over all rows. The sign of a component is free."""
    n = df.count()
    k = max(1, min(k, len(names), n - 1))
    scaled = standardize(df, fit_scaler(df, names, scope="all"))
    keys = [c for c in (ID, TARGET) if c in df.columns]
    rows = scaled.select(*keys, array_to_vector(F.array(*[
        F.col(f"`{c}`").cast("double") for c in names])).alias(VECTOR))
    model = PCA(k=k, inputCol=VECTOR, outputCol="scores").fit(rows)
    out = model.transform(rows).select(*keys, vector_to_array("scores").alias(FEATURES))
    return Matrix(out, tuple(f"pc_{i + 1}" for i in range(k)))


def spread(m: Matrix) -> DataFrame:
    """Array columns as wide columns."""
    return m.df.select(
        *[c for c in m.df.columns if c != FEATURES],
        *[F.col(FEATURES)[i].alias(n) for i, n in enumerate(m.names)])


def subset(m: Matrix, names: Sequence[str]) -> Matrix:
    """A matrix with only these columns, in this order."""
    position = {n: i for i, n in enumerate(m.names)}
    picked = F.array(*[F.col(FEATURES)[position[n]] for n in names])
    return replace(m, df=m.df.withColumn(FEATURES, picked), names=tuple(names))
