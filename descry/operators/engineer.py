"""New columns from old ones (E1-E12, E15, E16, E21). Each is one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry import ID
from descry.functions.columns import TRANSFORMS, open_gates, product_parents, quoted
from descry.operators.cleaning import float_columns, integer_columns, train_rows
from descry.operators.profile import column_stats, distinct_beyond

MAX_LEVELS = 1000


def integer_levels(df: DataFrame, names: Sequence[str], max_levels: int = MAX_LEVELS
                   ) -> dict[str, list[int]]:
    """Distinct values of integer columns; a column beyond ``max_levels`` is refused by name.

    The bounded count runs first, so a key column is never gathered.
    """
    if not names:
        return {}
    seen = {r["feature"]: r["n_seen"] for r in distinct_beyond(df, names, max_levels).collect()}
    wide = [c for c in names if seen[c] > max_levels]
    if wide:
        raise ValueError(f"more than {max_levels} levels, not one-hot encoded: {wide}")
    long = df.select(*[quoted(c).cast("bigint").alias(c) for c in names]).unpivot(
        [], [quoted(c) for c in names], "feature", "value")
    levels: dict[str, list[int]] = {c: [] for c in names}
    for row in long.filter("value is not null").distinct().orderBy("value").collect():
        levels[row["feature"]].append(row["value"])
    return levels


def one_hot_integers(df: DataFrame, names: Sequence[str] | None = None,
                     max_levels: int = MAX_LEVELS,
                     levels: dict[str, list[int]] | None = None) -> DataFrame:
    """Integer columns become ``<column>_<value>`` 0/1 columns after the others.

    A null belongs to no level.
    """
    names = integer_columns(df) if names is None else list(names)
    if levels is None:
        levels = integer_levels(df, names, max_levels)
    kept = [quoted(c) for c in df.columns if c not in names]
    flags = [
        F.when(quoted(c) == v, 1).otherwise(0).alias(f"{c}_{v}") for c in names for v in levels[c]
    ]
    return df.select(*kept, *flags)


def one_hot_long(df: DataFrame, names: Sequence[str] | None = None, key: str = ID) -> DataFrame:
    """The ones of a one-hot encoding as (id, feature): sparse, so any number of levels will do,
    and no level is gathered. A null belongs to no level."""
    names = integer_columns(df) if names is None else list(names)
    long = df.select(quoted(key), *[quoted(c).cast("bigint").alias(c) for c in names]).unpivot(
        [quoted(key)], [quoted(c) for c in names], "column", "level").filter("level is not null")
    return long.select(quoted(key), F.concat_ws("_", "column", F.col("level").cast("string")).alias("feature"))


def column_ranges(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    if not names:
        return {}
    return {r["feature"]: (r["low"], r["high"])
            for r in column_stats(df, names).select("feature", "low", "high").collect()}


def nonlinear_plan(df: DataFrame, names: Sequence[str] | None = None, scope: str = "all"
                   ) -> list[tuple[str, str]]:
    """(column, transform) pairs whose gates are open, from one min/max pass."""
    names = float_columns(df) if names is None else list(names)
    ranges = column_ranges(train_rows(df) if scope == "train" else df, names)
    return [(c, suffix) for c in names for suffix in open_gates(*ranges[c])]


def nonlinear_expand(df: DataFrame, names: Sequence[str] | None = None, scope: str = "all",
                     plan: list[tuple[str, str]] | None = None) -> DataFrame:
    """Adds ``<column>_<transform>`` for every open gate of the original float columns."""
    if plan is None:
        plan = nonlinear_plan(df, names, scope)
    return df.select(
        "*", *[TRANSFORMS[s](quoted(c).cast("double")).alias(f"{c}_{s}") for c, s in plan]
    )


def interaction_values(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds ``a*b`` per pair."""
    return df.select("*", *[(quoted(a) * quoted(b)).alias(f"{a}*{b}") for a, b in pairs])


def parents_of(names: Sequence[str]) -> list[tuple[str, str]]:
    """Pairs behind the product names of a feature list."""
    return [tuple(n.split("*")) for n in names if n.count("*") == 1]


def listed_pairs(listed: DataFrame) -> list[tuple[str, str]]:
    """The same from a feature-list table, in name order."""
    parents = listed.select("feature", product_parents(F.col("feature")).alias("p"))
    return [(r["p"][0], r["p"][1])
            for r in parents.filter(F.size("p") == 2).orderBy("feature").collect()]


def feature_catalog(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(idx, feature, kind, parents, op): what each column is, read from its name."""
    known, rows = set(names), []
    for i, name in enumerate(names):
        stem, _, suffix = name.rpartition("_")
        if name.count("*") == 1:
            row = ("product", name.split("*"), "*")
        elif suffix in TRANSFORMS and stem in known:
            row = ("transform", [stem], suffix)
        elif stem and suffix.removeprefix("-").isdigit() and stem not in known:
            row = ("level", [stem], suffix)
        else:
            row = ("raw", [], None)
        rows.append((i, name, *row))
    return spark.createDataFrame(
        rows, "idx int, feature string, kind string, parents array<string>, op string")


def interaction_from_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Recreates the products named in a saved list."""
    return interaction_values(df, parents_of(names))


def combine_features(df: DataFrame, plan: Sequence[tuple[str, str]],
                     pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Transforms and products side by side; both come from the same row, so no join."""
    return df.select(
        "*",
        *[TRANSFORMS[s](quoted(c).cast("double")).alias(f"{c}_{s}") for c, s in plan],
        *[(quoted(a) * quoted(b)).alias(f"{a}*{b}") for a, b in pairs],
    )


def transform_correlation(df: DataFrame, names: Sequence[str],
                          suffixes: Sequence[str] = ("log", "sqrt", "cube", "sq")) -> DataFrame:
    """Correlation of each column with its own transforms; ``log`` and ``sqrt`` skip values
    they are not defined for."""
    exprs, tags = [], []
    for c in names:
        x = quoted(c).cast("double")
        for s in suffixes:
            y = TRANSFORMS[s](x)
            if s in ("log", "log2", "log10", "sqrt", "cubert"):
                y = F.when(x > 0, y)
            exprs.append(F.corr(x, y).alias(f"r{len(tags)}"))
            tags.append((c, s))
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(s).alias("transform"),
                              F.col(f"r{i}").alias("r")) for i, (c, s) in enumerate(tags)])
    return df.agg(*exprs).select(F.inline(rows))
