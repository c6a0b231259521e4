"""Fold scores (V3-V8, V10-V13) and their means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descry.operators.ordered import ROWS_PER_TASK, running_sums

FOLD = ("model", "repeat", "fold")
# The names of the scores in the output.
METRICS = ("r2_score", "explained_variance", "mean_sq_error", "root_mean_sq_error",
           "mean_absolute_error", "median_absolute_error")
LOG_LOSS_EPS = 1e-15  # fixed value: predicted probabilities are clipped to [eps, 1 - eps]
MEDIAN_ACCURACY = 10_000


def exact_median(errors: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, median): exact, by narrowing each group to its middle before ordering it.

    An approximate quantile with guaranteed rank error brackets the middle; what lies below
    the bracket is only counted, and just the bracket (about 4/10000 of a group, ties
    pre-counted) is put in order.
    """
    keys = list(keys)
    slack = 2.0 / MEDIAN_ACCURACY
    brackets = errors.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.percentile_approx(value, F.array(F.lit(0.5 - slack), F.lit(0.5 + slack)),
                            F.lit(MEDIAN_ACCURACY)).alias("b"),
        F.min(value).alias("least"), F.max(value).alias("most"),
    ).select(*keys, "n",
             F.when(F.col("n") < MEDIAN_ACCURACY, F.col("least")).otherwise(F.col("b")[0]).alias("lo"),
             F.when(F.col("n") < MEDIAN_ACCURACY, F.col("most")).otherwise(F.col("b")[1]).alias("hi"))
    # one row per model and fold: splits are capped, so this side is small by construction
    placed = errors.join(F.broadcast(brackets), keys).select(
        *keys, "n", value,
        F.when(F.col(value) < F.col("lo"), F.lit(-1)).when(F.col(value) > F.col("hi"), F.lit(1))
        .otherwise(F.lit(0)).alias("side"))
    counted = placed.filter("side <= 0").groupBy(
        *keys, "n", F.when(F.col("side") == 0, F.col(value)).alias("v")
    ).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0)
    cum = counted.select(*keys, "n", "v", F.sum("c").over(w).alias("upto"), "c")
    low_rank = F.floor((F.col("n") + 1) / 2)
    high_rank = F.floor((F.col("n") + 2) / 2)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank), F.col("v")))

    return cum.groupBy(*keys).agg(((at(low_rank) + at(high_rank)) / 2).alias("median"))


def fold_metrics(preds: DataFrame, keys: Sequence[str] = FOLD, median: bool = True) -> DataFrame:
    """(keys, metric, value) from rows (keys, actual, prediction) in target units.

    Everything but the median comes from one aggregate. R^2 and explained variance are null
    for a fold whose actual values do not vary.
    """
    keys = list(keys)
    e = F.col("actual") - F.col("prediction")
    base = preds.select(*keys, "actual", e.alias("e"), F.abs(e).alias("abs_e"))
    scores = base.groupBy(*keys).agg(
        F.count("e").alias("n"),
        F.sum(F.col("e") * F.col("e")).alias("sse"),
        F.var_pop("actual").alias("var_y"),
        F.var_pop("e").alias("var_e"),
        F.avg("abs_e").alias("mae"),
    )
    mse = F.col("sse") / F.col("n")
    named = {
        "r2_score": F.when(F.col("var_y") > 0, 1 - mse / F.col("var_y")),
        "explained_variance": F.when(F.col("var_y") > 0, 1 - F.col("var_e") / F.col("var_y")),
        "mean_sq_error": mse,
        "root_mean_sq_error": F.sqrt(mse),
        "mean_absolute_error": F.col("mae"),
    }
    if median:
        scores = scores.join(exact_median(base, keys, "abs_e"), keys)
        named["median_absolute_error"] = F.col("median")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in named.items()])
    return scores.select(*keys, F.inline(rows))


def mean_metrics(scores: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Mean of each metric over folds and repeats."""
    return scores.groupBy(*keys, "metric").agg(F.avg("value").alias("value"))


def cv_predict_mean(preds: DataFrame, repeats: int, keys: Sequence[str] = ("model", "id")) -> DataFrame:
    """Mean held-out prediction per entity: each repeat holds it out once."""
    return preds.groupBy(*keys).agg((F.sum("prediction") / repeats).alias("prediction"))


def log_loss(preds: DataFrame, keys: Sequence[str], score: str = "predicted") -> DataFrame:
    """Clipped log loss of labels 0/1 against a label or probability column."""
    p = F.greatest(F.lit(LOG_LOSS_EPS), F.least(F.lit(1 - LOG_LOSS_EPS), F.col(score).cast("double")))
    one = F.when(F.col("actual") == 1, F.log(p)).otherwise(F.log(1 - p))
    return preds.groupBy(*keys).agg((-F.avg(one)).alias("log_loss"))


def roc_auc(preds: DataFrame, keys: Sequence[str], score: str = "predicted",
            rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Area under the ROC curve with ties: positives beat the negatives below them and tie
    half of those at their own score. Null when a fold has one class only."""
    keys = list(keys)
    counts = preds.groupBy(*keys, F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col("actual") == 1).alias("pos"), F.count_if(F.col("actual") == 0).alias("neg"))
    bound = preds.count()
    cum = running_sums(counts, keys, "s", ["neg"], bound, rows_per_task)
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return cum.groupBy(*keys).agg(F.try_divide(wins, pairs).alias("roc_auc"))


def confusion_matrix(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, actual, predicted, n): all four cells, absent ones as 0."""
    cells = F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"n{a}{b}").alias("n"))
        for a in (1, 0) for b in (1, 0)])
    counts = preds.groupBy(*keys).agg(*[
        F.count_if((F.col("actual") == a) & (F.col("predicted") == b)).alias(f"n{a}{b}")
        for a in (1, 0) for b in (1, 0)])
    return counts.select(*keys, F.inline(cells))


def mean_confusion(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return cells.groupBy(*keys, "actual", "predicted").agg(F.avg("n").alias("n"))


def class_report(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support for labels 1 and 0; 0 where undefined."""
    keys = list(keys)
    flat = cells.groupBy(*keys).agg(*[
        F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == b), F.col("n")).otherwise(0))
        .alias(f"n{a}{b}") for a in (1, 0) for b in (1, 0)])

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    rows = []
    for c in (1, 0):
        hit, other = F.col(f"n{c}{c}"), 1 - c
        rows.append(F.struct(
            F.lit(c).alias("label"),
            ratio(hit, hit + F.col(f"n{other}{c}")).alias("precision"),
            ratio(hit, hit + F.col(f"n{c}{other}")).alias("recall"),
            ratio(2 * hit, 2 * hit + F.col(f"n{other}{c}") + F.col(f"n{c}{other}")).alias("f1"),
            (hit + F.col(f"n{c}{other}")).cast("bigint").alias("support")))
    return flat.select(*keys, F.inline(F.array(*rows)))


def label_metrics(preds: DataFrame, keys: Sequence[str] = FOLD, score: str = "predicted") -> DataFrame:
    """Log loss and ROC AUC per fold; ``score`` may be a probability column."""
    return log_loss(preds, keys, score).join(roc_auc(preds, keys, score), list(keys))


def require_positives(preds: DataFrame, keys: Sequence[str]) -> None:
    """Every fold must hold a positive example."""
    bad = preds.groupBy(*keys).agg(F.count_if(F.col("actual") == 1).alias("p")).filter("p = 0")
    rows = bad.limit(5).collect()
    if rows:
        raise ValueError(f"no positive examples in folds {[tuple(r[:-1]) for r in rows]}")
