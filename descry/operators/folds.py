"""Repeated stratified folds (V1, A9) as a table, balanced exactly, without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from descry import ID, TARGET
from descry.functions.columns import label_below

REPEATS = 10
SEED = 2024
PREFIX = 3  # hex digits of the hash that name a bucket: 4096 buckets per repeat and class


def count_positives(df: DataFrame, cut: float) -> int:
    return int(df.agg(F.coalesce(F.sum(label_below(F.col(TARGET), cut)), F.lit(0))).first()[0])


def choose_splits(df: DataFrame, cut: float, n_splits: int | None, cap: int | None = None) -> int:
    """As many splits as positives, unless the caller gives their number or a cap."""
    k = n_splits
    if k is None:
        positives = count_positives(df, cut)
        k = positives if cap is None else min(positives, cap)
    if k < 2:
        raise ValueError(f"need at least two splits, got {k}")
    return k


def label_folds(labelled: DataFrame, n_splits: int, repeats: int = REPEATS, seed: int = SEED,
                prefix: int = PREFIX) -> DataFrame:
    """(id, repeat, fold) for rows (id, label).

    Within a repeat and class, rows are numbered in the order of md5(seed|repeat|id) and
    dealt to the folds in turn. The hash prefix cuts each class in buckets that are already
    in that order, so a row's number is the size of the buckets before its own plus its
    place inside: no task sorts a class.
    """
    key = F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), F.col(ID).cast("string"))
    dealt = labelled.select(
        ID, "label", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    ).select(ID, "label", "repeat", F.md5(key).alias("h"))
    dealt = dealt.withColumn("bucket", F.substring("h", 1, prefix))
    sizes = dealt.groupBy("repeat", "label", "bucket").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("repeat", "label").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select("repeat", "label", "bucket",
                           F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("repeat", "label", "bucket").orderBy("h", ID)
    placed = dealt.select("*", F.row_number().over(inside).alias("place"))
    # offsets: at most repeats x classes x 16^prefix rows, whatever the data
    return placed.join(F.broadcast(offsets), ["repeat", "label", "bucket"]).select(
        ID, "repeat",
        ((F.col("offset") + F.col("place") - 1) % n_splits).cast("int").alias("fold"))


def stratified_folds(df: DataFrame, cut: float, n_splits: int | None = None,
                     repeats: int = REPEATS, seed: int = SEED, prefix: int = PREFIX) -> DataFrame:
    """Folds of the rows that have a target; classes are ``y < cut`` and the rest."""
    train = df.filter(F.col(TARGET).isNotNull())
    k = choose_splits(train, cut, n_splits)
    labelled = train.select(ID, label_below(F.col(TARGET), cut).alias("label"))
    return label_folds(labelled, k, repeats, seed, prefix)


def with_folds(df: DataFrame, folds: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Adds ``folds array<int>``, one fold per repeat; each id has ``repeats`` rows to gather."""
    arrays = folds.groupBy(ID).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("repeat", "fold"))),
                    lambda s: s["fold"]).alias("folds"))
    return df.join(arrays, ID)


def require_unique_ids(df: DataFrame) -> None:
    twice = df.groupBy(ID).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate ids: {[r[0] for r in twice]}")
