"""Running sums per group that never sort a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descry.session import cut_lineage

ROWS_PER_TASK = 2_000_000
CELL = 16
RANGES = CELL * CELL
MAX_SPLITS = 4_000_000  # split points that may be broadcast; beyond, a plain join


def _range_of(value: Column, splits: Column) -> Column:
    """How many of up to 255 ascending split points lie below the value, in two short scans."""
    coarse = F.filter(splits, lambda s, i: (i % CELL == CELL - 1) & (s < value))
    start = F.size(coarse) * CELL
    fine = F.filter(F.slice(splits, start + 1, CELL), lambda s: s < value)
    return start + F.size(fine)


def running_sums(counts: DataFrame, groups: Sequence[str], value: str, sums: Sequence[str],
                 upper_bound: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Adds ``cum_<c>`` for each summed column: its total over values up to this one.

    ``counts`` holds one row per (group, value); ``upper_bound`` is a bound on the rows of
    any one group. Small groups are one window each. Larger ones are cut in value ranges:
    a window per range plus the totals of the ranges before it gives the same sums.
    """
    groups = list(groups)
    if upper_bound <= rows_per_task:
        w = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return counts.select("*", *[F.sum(c).over(w).alias(f"cum_{c}") for c in sums])

    counts = cut_lineage(counts)
    n_groups = counts.select(*groups).distinct().count()
    ranges = int(min(RANGES, max(2, MAX_SPLITS // max(1, n_groups)),
                     max(2, -(-upper_bound * 2 // rows_per_task))))
    points = [i / ranges for i in range(1, ranges)]
    splits = counts.groupBy(*groups).agg(
        F.percentile_approx(value, F.array(*[F.lit(p) for p in points]), F.lit(10 * RANGES))
        .alias("splits")
    )
    splits = cut_lineage(splits)  # the ranges must be the same in both passes below
    small = F.broadcast if n_groups * ranges <= MAX_SPLITS else (lambda side: side)
    ranged = counts.join(small(splits), groups).select(
        *counts.columns, _range_of(F.col(value), F.col("splits")).alias("range")
    )
    totals = ranged.groupBy(*groups, "range").agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    before = Window.partitionBy(*groups).orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *groups, "range",
        *[F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)).alias(f"o_{c}") for c in sums],
    )
    inside = Window.partitionBy(*groups, "range").orderBy(value).rowsBetween(
        Window.unboundedPreceding, 0
    )
    joined = ranged.join(small(offsets), [*groups, "range"])  # as many rows as split points
    return joined.select(
        *counts.columns,
        *[(F.sum(c).over(inside) + F.col(f"o_{c}")).alias(f"cum_{c}") for c in sums],
    )
