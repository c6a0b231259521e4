"""Scalar expressions. All are built-in Spark expressions, so they stay in codegen."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Transform suffixes and the strict limits that open them. "min" gates ask
# for a column minimum above the limit, "max" gates for a column maximum below it.
GATES: dict[str, tuple[str, float]] = {
    "log": ("min", 0.0),
    "log2": ("min", 0.0),
    "log10": ("min", 0.0),
    "cubert": ("min", 0.0),
    "sqrt": ("min", 0.0),
    "exp": ("max", 13.0),
    "exp2": ("max", 20.0),
    "cube": ("max", 100.0),
    "sq": ("max", 1000.0),
}

TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "log": F.log,
    "log2": F.log2,
    "log10": F.log10,
    "cubert": F.cbrt,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "exp2": lambda c: F.pow(F.lit(2.0), c),
    "cube": lambda c: c * c * c,
    "sq": lambda c: c * c,
}


def open_gates(low: float | None, high: float | None) -> list[str]:
    """Transforms allowed for a column with this minimum and maximum (nulls skipped)."""
    if low is None or high is None:
        return []
    return [
        suffix
        for suffix, (side, limit) in GATES.items()
        if (low > limit if side == "min" else high < limit)
    ]


def quoted(name: str) -> Column:
    """Column by literal name; names may hold dots or ``*``."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def numeric(name: str) -> Column:
    """Text to double; what does not parse becomes null."""
    return quoted(name).try_cast("double")


def label_below(y: Column, cut: float) -> Column:
    """1 when the target is under the cut, else 0."""
    return (y < F.lit(cut)).cast("int")


def product_name(a: Column | str, b: Column | str) -> Column:
    return F.concat_ws("*", a, b)


def product_parents(name: Column) -> Column:
    """``a*b`` to ``[a, b]``; other names give a one-element array."""
    return F.split(name, r"\*")


def run_name(n_feats: Column, rmse: Column) -> Column:
    return F.format_string("%d_feats_%.2f_rmse", n_feats, rmse)


# Fixed value: format of a run name.
RUN_PATTERN = r"^([0-9]+)_feats_(-?[0-9.]+)_rmse$"


def run_size(name: Column) -> Column:
    return F.regexp_extract(name, RUN_PATTERN, 1).try_cast("int")


def run_rmse(name: Column) -> Column:
    return F.regexp_extract(name, RUN_PATTERN, 2).try_cast("double")


def balanced_sum(terms: Sequence[Column]) -> Column:
    """Sum as a shallow tree, so that many terms do not nest deeply."""
    if not terms:
        return F.lit(0.0)
    terms = list(terms)
    while len(terms) > 1:
        paired = [terms[i] + terms[i + 1] for i in range(0, len(terms) - 1, 2)]
        terms = paired + terms[len(paired) * 2 :]
    return terms[0]


def dot(features: Column, weights: Sequence[float]) -> Column:
    """Dot product of an array column with constant weights, on the JVM side."""
    fixed = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(
        F.zip_with(features, fixed, lambda x, w: x * w), F.lit(0.0), lambda acc, v: acc + v
    )


def norm(features: Column) -> Column:
    return F.sqrt(F.aggregate(features, F.lit(0.0), lambda acc, v: acc + v * v))


def fill_named(df: DataFrame, value: float | int, names: Sequence[str]) -> DataFrame:
    """Fills nulls of columns whose names may hold dots."""
    named = set(names)
    types = dict(df.dtypes)
    return df.select(*[
        F.coalesce(quoted(c), F.lit(value).cast(types[c])).alias(c) if c in named else quoted(c)
        for c in df.columns])
