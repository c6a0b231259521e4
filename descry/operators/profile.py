"""Column profile and the screens that need nothing else."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry import FEATURES, TARGET
from descry.functions.columns import finite, quoted
from descry.operators.blocks import BLOCK, add_up, dense, matrix, sums_batch
from descry.operators.cleaning import train_rows
from descry.session import max_tasks

def _merge(block: np.ndarray) -> np.ndarray:
    """Merges stacked (n, rows, low, high, mean, squares about the mean) of many columns."""
    part = block.reshape(len(block), 6, -1)
    n, rows = part[:, 0].sum(axis=0), part[:, 1].sum(axis=0)
    safe = np.where(n > 0, n, 1.0)
    mean = (part[:, 0] * part[:, 4]).sum(axis=0) / safe
    squares = (part[:, 5] + part[:, 0] * (part[:, 4] - mean) ** 2).sum(axis=0)
    low, high = part[:, 2].min(axis=0), part[:, 3].max(axis=0)
    return np.concatenate([n, rows, low, high, mean, squares])


def _batch_stats(df: DataFrame, names: Sequence[str], packed: bool = False) -> DataFrame:
    """The figures of all columns: one numpy pass over batches, merged per block. Null, NaN and
    infinite values are missing alike. ``packed``: ``df`` holds them as its ``features`` array."""
    width = len(names)
    cuts = [slice(s, min(s + BLOCK, width)) for s in range(0, width, BLOCK)]
    tasks = max_tasks(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not len(batch):
                continue
            x = dense(batch, width)
            there = np.isfinite(x)
            x = np.where(there, x, 0.0)
            n = there.sum(axis=0).astype(float)
            mean = np.where(there, x, 0.0).sum(axis=0) / np.where(n > 0, n, 1.0)
            squares = (np.where(there, x - mean, 0.0) ** 2).sum(axis=0)
            low = np.where(there, x, np.inf).min(axis=0)
            high = np.where(there, x, -np.inf).max(axis=0)
            part = np.stack([n, np.full(width, float(len(x))), low, high, mean, squares])
            both = part[None] if total is None else np.stack([total, part])
            total = _merge(both.reshape(len(both), -1)).reshape(6, width)
        if total is not None:
            yield sums_batch({"block": list(range(len(cuts)))}, [total[:, c] for c in cuts])

    rows = (df.select(FEATURES) if packed else matrix(df, names, keep=()).df).coalesce(tasks)
    parts = rows.mapInArrow(run, "block int, sums array<double>")
    merged = add_up(parts, ["block"], tasks, combine=_merge)
    labels = np.array(list(names), dtype=object)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                cut = cuts[batch.column(0)[k].as_py()]
                n, total, low, high, mean, squares = np.array(
                    batch.column(1)[k].as_py()).reshape(6, -1)
                empty = n == 0
                squares = np.where(low == high, 0.0, squares)  # no rounding for constants
                values = {"low": low, "high": high, "mean": mean,
                          "var_pop": squares / np.where(empty, 1.0, n)}
                yield pa.RecordBatch.from_pydict({
                    "idx": pa.array(np.arange(cut.start, cut.stop, dtype=np.int32)),
                    "feature": pa.array(labels[cut], pa.string()),
                    "n": pa.array(n.astype(np.int64)), "n_null": pa.array((total - n).astype(np.int64)),
                    **{s: pa.array(v, mask=empty) for s, v in values.items()}})

    return merged.mapInArrow(finish, "idx int, feature string, n long, n_null long, low double, "
                                     "high double, mean double, var_pop double")


def array_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``column_stats`` of the positions of the ``features`` array, named by ``names``."""
    stats = _batch_stats(df, names, packed=True)
    return stats.withColumn("sd", F.sqrt(F.try_divide(F.col("var_pop") * F.col("n"), F.col("n") - 1)))


def column_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per column: counts, range, mean, population variance, sample sd.

    A global aggregate: each task sends one row per block of columns; no value leaves its
    partition. NaN and infinities count as null.
    """
    stats = _batch_stats(df, names)
    sd = F.sqrt(F.try_divide(F.col("var_pop") * F.col("n"), F.col("n") - 1))
    return stats.withColumn("sd", sd)


def column_profile(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Stats plus the exact number of distinct values.

    Values go to long form and are pre-aggregated per (column, value) before they move,
    so a value held by a third of the rows is one row per task.
    """
    long = df.select(*[finite(quoted(c)).alias(c) for c in names]).unpivot(
        [], [quoted(c) for c in names], "feature", "value"
    )
    return long.groupBy("feature").agg(
        F.count("value").alias("n"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.stddev_samp("value").alias("sd"),
        F.count_distinct("value").alias("n_unique"),
    )


def distinct_beyond(df: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """(feature, n_seen): distinct finite values, counted exactly up to ``k + 1``.

    Each task stops looking at a column after ``k + 1`` values, and tasks are bounded by the
    cores, so what moves is at most tasks x columns x (k + 1) rows whatever the data.
    """

    def bounded(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        seen: list[set[float]] = [set() for _ in names]
        for batch in batches:
            for i, values in enumerate(seen):
                if len(values) <= k:
                    column = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                    for v in np.unique(column)[: k + 1]:
                        values.add(float(v))
        rows = [(i, v) for i, values in enumerate(seen) for v in sorted(values)[: k + 1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()),
             pa.array([r[1] for r in rows], pa.float64())],
            names=["idx", "value"],
        )

    values = df.select(*[finite(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)])
    tasks = max_tasks(df.sparkSession)
    seen = values.coalesce(tasks).mapInArrow(bounded, "idx int, value double")
    counted = seen.groupBy("idx").agg(F.count_distinct("value").alias("n_seen"))
    catalog = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(c).alias("feature"))
                        for i, c in enumerate(names)])
    all_names = df.sparkSession.range(1).select(F.inline(catalog))
    return all_names.join(counted, "idx", "left").select(
        "idx", "feature", F.coalesce("n_seen", F.lit(0)).alias("n_seen")
    )


def _scoped(df: DataFrame, scope: str) -> DataFrame:
    if scope not in ("all", "train"):
        raise ValueError("scope is 'all' or 'train'")
    return train_rows(df) if scope == "train" else df


def zero_variance_screen(df: DataFrame, names: Sequence[str], scope: str = "all") -> DataFrame:
    """Stats rows of the columns whose sample sd is above zero."""
    return column_stats(_scoped(df, scope), names).filter("sd > 0")


def low_cardinality_screen(df: DataFrame, names: Sequence[str], k: int = 3,
                           scope: str = "all") -> DataFrame:
    """Columns with more than ``k`` distinct values."""
    return distinct_beyond(_scoped(df, scope), names, k).filter(F.col("n_seen") > k)


def null_column_screen(df: DataFrame, names: Sequence[str], scope: str = "all") -> DataFrame:
    """Columns without any null."""
    return column_stats(_scoped(df, scope), names).filter("n_null = 0")


def feature_names(screened: DataFrame) -> list[str]:
    """Surviving names in column order (column-count sized)."""
    return [r["feature"] for r in screened.select("idx", "feature").orderBy("idx").collect()]


def require_varying_target(df: DataFrame) -> None:
    """The target is exempt from the screens, but a constant one cannot be modelled."""
    sd = df.agg(F.stddev_samp(TARGET)).first()[0]
    if not sd:
        raise ValueError("the target is constant or missing")


def variance_score(stats: DataFrame) -> Column:
    """Default scorer of ``select_k``: population variance."""
    return F.col("var_pop")


def select_k(df: DataFrame, names: Sequence[str], k: int = 5,
             scorer: Callable[[DataFrame], Column] = variance_score) -> DataFrame:
    """The ``k`` best columns by a score over their stats; ties go to the earlier column."""
    stats = column_stats(df, names)
    return stats.withColumn("score", scorer(stats)).orderBy(F.desc("score"), "idx").limit(k)


def screen_report(df: DataFrame, names: Sequence[str], k: int = 3) -> DataFrame:
    """Columns before and after each simple screen, applied in order."""
    stats = column_stats(df, names).select("idx", "feature", "n_null", "sd")
    seen = distinct_beyond(df, names, k).select("idx", "n_seen")
    flags = stats.join(seen, "idx").select(
        (F.coalesce(F.col("sd"), F.lit(0.0)) > 0).alias("varies"),
        (F.col("n_seen") > k).alias("many"),
        (F.col("n_null") == 0).alias("whole"),
    )
    steps = [("zero_variance", F.lit(True), F.col("varies")),
             ("low_cardinality", F.col("varies"), F.col("many")),
             ("null_column", F.col("varies") & F.col("many"), F.col("whole"))]
    counts = [c for i, (_, before, keep) in enumerate(steps) for c in (
        F.count_if(before).alias(f"b{i}"), F.count_if(before & keep).alias(f"a{i}"))]
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("stage"),
                 F.col(f"b{i}").alias("n_before"), F.col(f"a{i}").alias("n_after"),
                 (F.col(f"b{i}") - F.col(f"a{i}")).alias("n_removed"))
        for i, (name, _, _) in enumerate(steps)
    ])
    return flags.agg(*counts).select(F.inline(rows))
