"""Summaries over many runs (A4-A6, A10, W1, W3, W4, M9-M11) from the long run log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry import ID
from descry.functions.columns import run_rmse, run_size
from descry.functions.stats import Z_99


def interval(mean: Column, sd: Column, n: Column, z: float = Z_99) -> tuple[Column, Column]:
    half = F.lit(z) * sd / F.sqrt(n)
    return mean - half, mean + half


def prediction_intervals(runs: DataFrame, key: str = ID, value: str = "prediction") -> DataFrame:
    """(id, n, low, mean, high, sd): 99% interval of each entity over the runs."""
    stats = runs.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                  F.stddev_samp(value).alias("sd"))
    low, high = interval(F.col("mean"), F.col("sd"), F.col("n"))
    return stats.select(key, "n", low.alias("low"), "mean", high.alias("high"), "sd")


def rank_entities(intervals: DataFrame, key: str = ID) -> DataFrame:
    """Entities nearest to zero first, narrow intervals before wide ones."""
    return intervals.withColumn("width", F.col("high") - F.col("low")).orderBy(
        F.abs("mean"), "width", key)


def n_runs(coefs: DataFrame) -> int:
    return coefs.select("run_id").distinct().count()


def feature_importance(coefs: DataFrame, total_runs: int, catalog: DataFrame | None = None) -> DataFrame:
    """(feature, selected_percent, min_99_coef, coef_mean, max_99_coef).

    A run that did not select a feature counts as a zero coefficient. The zeros enter the
    formulas by their number; no feature-by-run table is made. Names of a catalog that no
    run selected get zeros.
    """
    n = F.lit(float(total_runs))
    sums = coefs.groupBy("feature").agg(
        F.count_if(F.col("coef") != 0).alias("hits"), F.count("coef").alias("k"),
        F.avg("coef").alias("avg"), F.var_pop("coef").alias("var"))
    if catalog is not None:
        sums = catalog.select("feature").join(sums, "feature", "left").na.fill(0)
    mean = F.col("avg") * F.col("k") / n
    squares = (F.col("k") * F.col("var") + F.col("k") * F.pow(F.col("avg") - mean, 2)
               + (n - F.col("k")) * mean * mean)
    sd = F.sqrt(F.try_divide(squares, n - 1))
    low, high = interval(mean, sd, n)
    return sums.select("feature", (F.col("hits") / n).alias("selected_percent"),
                       low.alias("min_99_coef"), mean.alias("coef_mean"), high.alias("max_99_coef"))


def sorted_importance(importance: DataFrame) -> DataFrame:
    return importance.orderBy(F.desc("selected_percent"), "feature")


def top_features(importance: DataFrame, by: str = "selected_percent", k: int = 10) -> DataFrame:
    return importance.orderBy(F.desc(by), "feature").limit(k)


def positive_coefficients(coefs: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return coefs.groupBy(*keys).agg(F.count_if(F.col("coef") > 0).alias("n_positive"))


def good_runs(scores: DataFrame, least: float = 0.75) -> DataFrame:
    """Runs whose mean R^2 reaches the bound."""
    return scores.filter(F.col("r2") >= least)


def check_runs(named: DataFrame, rtol: float = 0.001) -> DataFrame:
    """Raises unless the size and score in each run's name match the recomputed ones.

    Takes (run, n_feats, rmse).
    """
    size, rmse = run_size(F.col("run")), run_rmse(F.col("run"))
    bad = named.filter(size.isNull() | rmse.isNull() | (size != F.col("n_feats"))
                       | (F.abs(F.col("rmse") - rmse) > 1e-8 + rtol * F.abs(rmse)))
    rows = bad.limit(5).collect()
    if rows:
        raise ValueError(f"stored runs do not match: {[r['run'] for r in rows]}")
    return named


def refit_coefficients(m, run_features: DataFrame, fit) -> DataFrame:
    """(run_id, feature, coef): each stored run's features fitted again on the train rows.

    A run's feature names are column-count sized; ``fit(matrix)`` gives a linear model.
    """
    from descry.operators.trees import subset

    names: dict[int, list[str]] = {}
    for r in run_features.select("run_id", "feature").orderBy("run_id", "feature").collect():
        names.setdefault(r["run_id"], []).append(r["feature"])
    rows = [(run, f, w) for run, features in names.items() for model in [fit(subset(m, features))]
            for f, w in zip(model.names, model.coef, strict=True)]
    return m.df.sparkSession.createDataFrame(rows, "run_id int, feature string, coef double")
