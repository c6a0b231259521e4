"""The run log (S5): long, append-only; wide on request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry import ID
from descry.functions.columns import fill_named, quoted, run_name


def append_runs(df: DataFrame, path: str) -> None:
    """Add runs as new files. A run adds rows, never a column, so nothing is rewritten."""
    df.write.mode("append").partitionBy("run_id").parquet(path)


def named_runs(runs: DataFrame) -> DataFrame:
    """Adds ``run`` built from the stored size and score."""
    return runs.withColumn("run", run_name(F.col("n_feats").cast("int"), F.col("rmse")))


def wide_runs(runs: DataFrame, key: str, value: str, names: list[str] | None = None,
              fill: float | int | None = None) -> DataFrame:
    """One column per run, in name order; ``fill`` for keys a run did not touch."""
    if names is None:
        names = sorted(r[0] for r in runs.select("run").distinct().collect())
    wide = runs.groupBy(key).pivot("run", names).agg(F.first(value, ignorenulls=True))
    return wide if fill is None else fill_named(wide, fill, names)


def selected_flags(run_features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Wide 0/1 integers: which run selected which feature."""
    flags = run_features.withColumn("picked", F.lit(1))
    return wide_runs(flags, "feature", "picked", names, fill=0)


def merge_run(wide: DataFrame, run: DataFrame, key: str, name: str, value: str,
              fill: float | int | None = None) -> DataFrame:
    """Full outer join of one more run column onto a wide table."""
    added = run.select(quoted(key), quoted(value).alias(name))
    merged = wide.join(added, on=key, how="full")
    return merged if fill is None else fill_named(merged, fill, [c for c in merged.columns if c != key])


def long_runs(wide: DataFrame, key: str = ID, value: str = "prediction") -> DataFrame:
    """Wide run table back to (key, run, value), nulls dropped."""
    names = [c for c in wide.columns if c != key]
    return wide.unpivot([quoted(key)], [quoted(c) for c in names], "run", value).filter(
        F.col(value).isNotNull()
    )
