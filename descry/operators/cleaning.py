"""Row and column choices (P1-P11) and keyed joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType

from descry import ID, TARGET
from descry.functions.columns import fill_named, finite, numeric, quoted


def descriptor_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (ID, TARGET)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.name not in (ID, TARGET)
            and isinstance(f.dataType, FractionalType)]


def integer_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.name not in (ID, TARGET)
            and isinstance(f.dataType, IntegralType)]


def pick(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Key, target (when there) and the named descriptors, in that order."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing[:10]}")
    keys = [c for c in (ID, TARGET) if c in df.columns]
    return df.select(*[quoted(c) for c in [*keys, *names]])


def train_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(TARGET).isNotNull())


def test_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(TARGET).isNull())


def complete_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def coerce_numeric(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    names = set(descriptor_columns(df) if names is None else names)
    return df.select(*[numeric(c).alias(c) if c in names else quoted(c) for c in df.columns])


def fill_missing(df: DataFrame, value: float = 0.0,
                 names: Sequence[str] | None = None) -> DataFrame:
    """Fills descriptors only, never the target."""
    return fill_named(df, value, descriptor_columns(df) if names is None else names)


def drop_infinite(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every fractional descriptor."""
    floats = set(float_columns(df))
    return df.select(*[finite(quoted(c)).alias(c) if c in floats else quoted(c)
                       for c in df.columns])


def require_no_nulls(df: DataFrame) -> DataFrame:
    """One aggregate over all descriptors; raises with the offending names."""
    names = descriptor_columns(df)
    if not names:
        return df
    row = df.agg(*[F.count_if(quoted(c).isNull()).alias(f"n{i}")
                   for i, c in enumerate(names)]).first()
    bad = {c: row[i] for i, c in enumerate(names) if row[i]}
    if bad:
        raise ValueError(f"unexpected nulls: {bad}")
    return df


def first_columns(df: DataFrame, k: int) -> DataFrame:
    return df.select(*[quoted(c) for c in df.columns[:k]])


def preview(df: DataFrame, columns: int, rows: int, order: str = ID) -> DataFrame:
    """The first rows by key and their first columns."""
    return first_columns(df, columns).orderBy(quoted(order)).limit(rows)


def join_inner(left: DataFrame, right: DataFrame, key: str = ID) -> DataFrame:
    return left.join(right, on=key, how="inner")


def join_full(left: DataFrame, right: DataFrame, key: str = ID) -> DataFrame:
    return left.join(right, on=key, how="full")


def join_left_zero(left: DataFrame, right: DataFrame, key: str = ID) -> DataFrame:
    """Left join; what the right side lacks becomes 0."""
    added = [c for c in right.columns if c != key]
    return fill_named(left.join(right, on=key, how="left"), 0, added)


def keep_listed(catalog: DataFrame, listed: DataFrame, key: str = "feature") -> DataFrame:
    """Catalog rows whose name is in a feature list."""
    return catalog.join(listed.select(key), on=key, how="left_semi")
