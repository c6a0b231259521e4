"""Arrow batches as numpy blocks, and the two-round reduction of per-task partial results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry import FEATURES, ID, TARGET
from descry.functions.columns import quoted

BLOCK = 256  # columns per block
STATE = 256 << 20  # bytes of sums one task may hold
FAN_IN = 64  # partial sums added by one task



@dataclass(frozen=True)
class Matrix:
    """Rows with one array column ``features``; ``names`` gives its positions."""

    df: DataFrame
    names: tuple[str, ...]


def matrix(df: DataFrame, names: Sequence[str], keep: Sequence[str] = (ID, TARGET)) -> Matrix:
    cols = [quoted(c) for c in keep if c in df.columns]
    packed = F.array(*[quoted(c).cast("double") for c in names]).alias(FEATURES)
    return Matrix(df.select(*cols, packed), tuple(names))


def dense(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The features of a batch as rows x columns; a null becomes NaN and spoils its sums."""
    column = batch.column(batch.schema.get_field_index(FEATURES))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)


def array_at(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    """One array cell of a batch."""
    cell = batch.column(batch.schema.get_field_index(name))[row]
    return cell.values.to_numpy(zero_copy_only=False)


def values_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def sums_batch(keys: dict[str, list[int]], values: list[np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(v, pa.int32()) for v in keys.values()]
    arrays.append(pa.array([v.ravel() for v in values], pa.list_(pa.float64())))
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, "sums"])


def plain_sum(block: np.ndarray) -> np.ndarray:
    return block.sum(axis=0)


def add_up(partials: DataFrame, keys: Sequence[str], n_partials: int, fan_in: int = FAN_IN,
           combine: Callable[[np.ndarray], np.ndarray] = plain_sum) -> DataFrame:
    """Adds array partials per key in rounds of about ``fan_in``; ``combine`` turns a stack of
    partials into one.

    ``n_partials`` bounds the partials of one key, one per task. No group holds more than
    the larger of ``fan_in`` and the square root of that.
    """
    keys = list(keys)
    schema = ", ".join(f"{k} int" for k in keys) + ", sums array<double>"

    def add(table: pa.Table) -> pa.Table:
        parts = [c for c in table.column("sums").chunks if len(c)]
        width = len(parts[0][0])
        total = combine(np.concatenate([
            c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), width) for c in parts]))
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys},
                         "sums": pa.array([total], pa.list_(pa.float64()))})

    if n_partials > fan_in:
        lanes = max(2, int(np.ceil(np.sqrt(n_partials))))
        lane = F.pmod(F.spark_partition_id(), F.lit(lanes))
        partials = partials.withColumn("lane", lane)
        partials = partials.groupBy(*keys, "lane").applyInArrow(add, schema)
    return partials.groupBy(*keys).applyInArrow(add, schema)


DIRECT = 32 << 20  # bytes of partials the driver may add up itself


def gather_sums(partials: DataFrame, keys: Sequence[str], n_partials: int, size: int
                ) -> dict[tuple[int, ...], np.ndarray]:
    """Sums per key on the driver, for results of column size.

    ``size`` is the number of doubles one task emits. A few small partials are added up
    right here; more are added up by the cluster first.
    """
    if n_partials * size * 8 > DIRECT:
        partials = add_up(partials, keys, n_partials)
    out: dict[tuple[int, ...], np.ndarray] = {}
    for row in partials.collect():
        key = tuple(row[k] for k in keys)
        value = np.array(row["sums"])
        out[key] = out[key] + value if key in out else value
    return out
