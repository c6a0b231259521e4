"""Two-sample Kolmogorov-Smirnov screen (F4, F5) and the screened profile built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry import TARGET
from descry.functions.columns import quoted
from descry.functions.stats import ks_pvalue
from descry.operators.ordered import ROWS_PER_TASK, running_sums
from descry.operators.profile import column_stats, distinct_beyond


def side_sizes(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Non-null values per column without and with a target; one global aggregate."""
    test = F.col(TARGET).isNull()
    exprs = []
    for i, c in enumerate(names):
        there = quoted(c).isNotNull()
        exprs += [F.count_if(test & there).alias(f"a{i}"), F.count_if(~test & there).alias(f"b{i}")]
    row = df.agg(*exprs).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(names)}


def ks_two_sample(df: DataFrame, names: Sequence[str],
                  sizes: dict[str, tuple[int, int]] | None = None,
                  rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Per column: sizes of both sides, distinct values, largest gap ``d`` and ``p_value``.

    Rows without target are one side, rows with target the other. Values are counted per
    (column, value) first, with partial counts before the shuffle, so ties cost nothing.
    A side without values gives null.
    """
    if not sizes:
        sizes = side_sizes(df, names)
    n_rows = max((a + b for a, b in sizes.values()), default=0)
    long = df.select(
        F.col(TARGET).isNull().alias("is_test"),
        *[quoted(c).cast("double").alias(c) for c in names],
    ).unpivot(["is_test"], [quoted(c) for c in names], "feature", "value")
    totals = df.sparkSession.createDataFrame(
        [(c, a, b) for c, (a, b) in sizes.items()], "feature string, n_test long, n_train long"
    )
    return ks_of_long(long, totals, n_rows, rows_per_task)


def ks_of_long(long: DataFrame, totals: DataFrame, n_rows: int,
               rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The statistic from values in long form (is_test, feature, value) and the side sizes
    (feature, n_test, n_train); ``n_rows`` bounds the values of one feature."""
    counts = (
        long.filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count_if("is_test").alias("test"), F.count_if(~F.col("is_test")).alias("train"))
    )
    summed = running_sums(counts, ["feature"], "value", ["test", "train"], n_rows, rows_per_task)
    # one row per feature: bounded by the number of features in this call
    gap = F.abs(F.try_divide(F.col("cum_test"), F.col("n_test"))
                - F.try_divide(F.col("cum_train"), F.col("n_train")))
    out = (
        summed.join(F.broadcast(totals), "feature")
        .groupBy("feature")
        .agg(F.first("n_test").alias("n_test"), F.first("n_train").alias("n_train"),
             F.count("value").alias("n_unique"), F.max(gap).alias("d"))
    )
    return out.select("*", ks_pvalue(F.col("d"), F.col("n_test"), F.col("n_train"))
                      .alias("p_value"))


def ks_filter(df: DataFrame, names: Sequence[str], alpha: float = 0.10,
              sizes: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Columns whose two sides are not told apart at ``alpha``."""
    return ks_two_sample(df, names, sizes).filter(F.col("p_value") > alpha)


def screened_profile(df: DataFrame, names: Sequence[str], alpha: float = 0.10, k: int = 3
                     ) -> DataFrame:
    """Variance, cardinality, null and distribution screens in order; one row per survivor."""
    seen = distinct_beyond(df, names, k)
    stats = column_stats(df, names).drop("feature").join(seen, "idx")
    kept = stats.filter((F.col("sd") > 0) & (F.col("n_seen") > k) & (F.col("n_null") == 0))
    rows = kept.select("idx", "feature", "sd").orderBy("idx").collect()
    spark = df.sparkSession
    if not rows:
        return spark.createDataFrame(
            [], "feature string, sd double, n_unique long, d double, p_value double")
    spread = spark.createDataFrame([(r["feature"], r["sd"]) for r in rows],
                                   "feature string, sd double")
    passed = ks_filter(df, [r["feature"] for r in rows], alpha)
    return passed.join(F.broadcast(spread), "feature").select(
        "feature", "sd", "n_unique", "d", "p_value")


def ks_names(df: DataFrame, names: Sequence[str], alpha: float = 0.10) -> list[str]:
    """Survivors of the distribution screen, in column order."""
    kept = {r[0] for r in ks_filter(df, names, alpha).select("feature").collect()}
    return [n for n in names if n in kept]


__all__ = ["ks_filter", "ks_names", "ks_of_long", "ks_two_sample", "screened_profile"]
