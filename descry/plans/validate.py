"""Cross-validation, scores and the leaderboard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType

from descry import FEATURES, ID, TARGET
from descry.operators.cleaning import pick, test_rows, train_rows
from descry.operators.folds import (REPEATS, SEED, choose_splits, label_folds,
                                    require_unique_ids, stratified_folds, with_folds)
from descry.operators.linear import LinearModel, predict_folds
from descry.operators.metrics import (class_report, confusion_matrix, cv_predict_mean, fold_metrics,
                                      label_metrics, mean_confusion, mean_metrics, require_positives)
from descry.operators.blocks import Matrix, matrix
from descry.operators.trees import VECTOR
from descry.plans.models import ModelSpec
from descry.plans.recipes import Prepared
from descry.session import cut_lineage


@dataclass(frozen=True)
class RegressionScores:
    folds: DataFrame  # model, repeat, fold, metric, value
    means: DataFrame  # model, metric, value
    predictions: DataFrame  # model, id, prediction: mean held-out prediction
    n_splits: int
    repeats: int


@dataclass(frozen=True)
class ClassificationScores:
    folds: DataFrame  # repeat, fold, log_loss, roc_auc
    confusion: DataFrame  # actual, predicted, n: mean over folds
    report: DataFrame  # repeat, fold, label, precision, recall, f1, support
    n_splits: int


def require_float_target(df: DataFrame) -> None:
    if not isinstance(df.schema[TARGET].dataType, FractionalType):
        raise TypeError(f"a regression target must be float, not {df.schema[TARGET].dataType}")


def require_label(df: DataFrame, label: str) -> None:
    if not isinstance(df.schema[label].dataType, IntegralType):
        raise TypeError(f"class labels must be integers, not {df.schema[label].dataType}")


def cross_validate(m: Matrix, estimator, folds: DataFrame, repeats: int, n_splits: int) -> DataFrame:
    """(id, repeat, fold, actual, prediction) from models that did not see the row.

    Linear estimators fit all folds together. Any other object with Spark's fit and
    transform is fitted per fold.
    """
    held = Matrix(with_folds(train_rows(m.df), folds), m.names)
    if hasattr(estimator, "fit_folds"):
        models = estimator.fit_folds(held, repeats, n_splits)
        return predict_folds(held, models, repeats, n_splits)
    rows = held.df.withColumn(VECTOR, array_to_vector(F.col(FEATURES))).persist()
    out = None
    for r in range(repeats):
        for f in range(n_splits):
            fold = F.col("folds")[r]
            fitted = estimator.fit(rows.filter(fold != f))
            part = fitted.transform(rows.filter(fold == f)).select(
                ID, F.lit(r).alias("repeat"), F.lit(f).alias("fold"),
                F.col(TARGET).alias("actual"), "prediction")
            out = part if out is None else out.unionByName(part)
    return out


def score_regressor(prepared: Prepared, names: Sequence[str], estimator, cut: float,
                    name: str = "model", n_splits: int | None = None, repeats: int = REPEATS,
                    seed: int = SEED) -> RegressionScores:
    """Repeated stratified folds; all scores are in target units. ``cut`` is in target units."""
    require_float_target(prepared.df)
    train = prepared.train
    scaled_cut = prepared.cut(cut)
    k = choose_splits(train, scaled_cut, n_splits)
    folds = stratified_folds(train, scaled_cut, k, repeats, seed)
    preds = cross_validate(matrix(train, names), estimator, folds, repeats, k).select(
        F.lit(name).alias("model"), ID, "repeat", "fold",
        prepared.invert(F.col("actual")).alias("actual"),
        prepared.invert(F.col("prediction")).alias("prediction"))
    preds = cut_lineage(preds)  # read by three aggregates below
    scores = fold_metrics(preds)
    return RegressionScores(scores, mean_metrics(scores), cv_predict_mean(preds, repeats), k, repeats)


def score_classifier(df: DataFrame, names: Sequence[str], label: str, estimator,
                     n_splits: int | None = None, repeats: int = REPEATS, seed: int = SEED,
                     probability: str | None = None) -> ClassificationScores:
    """Stratified folds of an integer label; a Spark classifier is fitted per fold.

    Log loss and AUC take the predicted labels unless a probability column is named.
    """
    require_label(df, label)
    rows = df.filter(F.col(label).isNotNull()).select(ID, F.col(label).cast("int").alias("label"), *names)
    k = rows.filter("label = 1").count() if n_splits is None else n_splits
    if k < 2:
        raise ValueError(f"need at least two splits, got {k}")
    folds = label_folds(rows.select(ID, "label"), k, repeats, seed)
    held = with_folds(rows, folds).withColumn(
        VECTOR, array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in names]))).persist()
    preds = None
    for r in range(repeats):
        for f in range(k):
            fold = F.col("folds")[r]
            out = estimator.fit(held.filter(fold != f)).transform(held.filter(fold == f))
            score = F.col("prediction") if probability is None else F.col(probability)
            part = out.select(ID, F.lit(r).alias("repeat"), F.lit(f).alias("fold"),
                              F.col("label").alias("actual"),
                              F.col("prediction").cast("int").alias("predicted"),
                              score.cast("double").alias("score"))
            preds = part if preds is None else preds.unionByName(part)
    preds = cut_lineage(preds)
    held.unpersist()
    keys = ["repeat", "fold"]
    require_positives(preds, keys)
    cells = confusion_matrix(preds, keys)
    return ClassificationScores(label_metrics(preds, keys, "score"), mean_confusion(cells),
                                class_report(cells, keys), k)


def train_r2(m: Matrix, model: LinearModel) -> DataFrame:
    """R^2 of a model on the rows it was fitted on; one aggregate."""
    value = model.array_column(m.names)
    e = F.col(TARGET) - value
    mse, var = F.avg(e * e), F.var_pop(TARGET)
    return train_rows(m.df).agg((1 - F.try_divide(mse, var)).alias("r2"))


def leaderboard(df: DataFrame, specs: Sequence[ModelSpec], cut: float, n_splits: int | None = None,
                repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """(scores, predictions) of all specs: mean scores per model; per entity the mean held-out
    prediction with the actual value (train) or the final model's prediction (test)."""
    require_unique_ids(df)
    scores = predictions = None
    for spec in specs:
        prepared = spec.recipe.prepare(df)
        names = spec.select(prepared)
        # many passes follow: they read a narrow table instead of repeating the recipe
        prepared = replace(prepared, df=cut_lineage(pick(prepared.df, names)))
        found = score_regressor(prepared, names, spec.estimator, cut, spec.name, n_splits, repeats)
        final = spec.estimator.fit(prepared.matrix(names))
        actual = train_rows(df).select(ID, F.col(TARGET).alias("actual"))
        train = found.predictions.join(actual, ID).select(
            "model", F.lit("train").alias("part"), ID, "actual", "prediction")
        test = test_rows(prepared.df).select(
            F.lit(spec.name).alias("model"), F.lit("test").alias("part"), ID,
            F.lit(None).cast("double").alias("actual"),
            prepared.invert(final.column()).alias("prediction"))
        both = train.unionByName(test)
        scores = found.means if scores is None else scores.unionByName(found.means)
        predictions = both if predictions is None else predictions.unionByName(both)
    return scores, predictions
