"""Descriptor tables as one array column and a catalog (D4, D5): thousands of columns.

A ``Wide`` table is (id, y, features array<double>) and a catalog that says what each
position is: a raw column (discrete or not), a level of one, a transform of one or a
product of two. Every step is a batch pass over positions, never a column per feature:

- statistics (count, nulls, range, mean, variances) of all positions are one numpy pass
  whose per-task partials the cluster merges (``array_stats``);
- bounded distinct counts are one pass with at most k + 1 values per position and task;
- keeping positions, one-hot levels, gated transforms (E11), products (E12, E15) and
  scaling (E17) are each one higher-order expression (``transform`` / ``zip_with``) over
  literal arrays of positions, whose size is the catalog's and not the rows';
- the distribution screen (F4, F5) counts (position, value) pairs in long form, partially
  before they move, then runs the distributed running sums of the column form;
- the product screen (E13, E14) adds up Gram blocks of the array as the column form does.

The profiles ``non_linear`` and ``ks_filtered`` (U1) follow the column recipes step by step
and give the same features in the same order, so a fit sees the same matrix. Only the
catalog (one entry per position) and per-position figures reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType

from descry import FEATURES, ID, TARGET
from descry.functions.columns import GATES, TRANSFORMS, finite, open_gates, quoted
from descry.operators.blocks import Matrix, dense
from descry.operators.cleaning import descriptor_columns
from descry.operators.ks import ks_of_long
from descry.operators.moments import screen_products, screened_pairs
from descry.operators.profile import array_stats, require_varying_target
from descry.session import max_tasks

MAX_LEVELS = 1000
SUFFIXES = tuple(GATES)  # transform codes are places in this tuple


@dataclass(frozen=True)
class Feature:
    """What a position holds: ``kind`` raw, level, transform or product."""

    name: str
    kind: str = "raw"
    parents: tuple[str, ...] = ()
    op: str | None = None
    discrete: bool = False


@dataclass(frozen=True)
class Wide:
    """Rows (id, y, features) and the catalog of the positions; ``mean``/``sd`` are the
    scaler of the positions and of y (last) once the table is standardised."""

    df: DataFrame
    catalog: tuple[Feature, ...]
    mean: tuple[float, ...] = field(default=())
    sd: tuple[float, ...] = field(default=())

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.catalog]

    def matrix(self) -> Matrix:
        return Matrix(self.df, tuple(self.names))

    def catalog_table(self, spark: SparkSession) -> DataFrame:
        """idx, feature, kind, parents, op: one row per position."""
        return spark.createDataFrame(
            [(i, f.name, f.kind, list(f.parents), f.op) for i, f in enumerate(self.catalog)],
            "idx int, feature string, kind string, parents array<string>, op string")

    def columns(self) -> DataFrame:
        """The column form, for reading or for a check; names as in the catalog."""
        keys = [c for c in (ID, TARGET) if c in self.df.columns]
        return self.df.select(*keys, *[F.col(FEATURES)[i].alias(n) for i, n in enumerate(self.names)])

    def invert(self, value: Column) -> Column:
        """Target units from model units."""
        return value * F.lit(self.sd[-1]) + F.lit(self.mean[-1]) if self.sd else value


def _keys(df: DataFrame) -> list[Column]:
    return [quoted(c) for c in (ID, TARGET) if c in df.columns]


def widen(df: DataFrame, names: Sequence[str] | None = None) -> Wide:
    """The descriptor columns as one array; NaN and infinities become null."""
    names = descriptor_columns(df) if names is None else list(names)
    kinds = {f.name: f.dataType for f in df.schema}
    bad = [n for n in names if not isinstance(kinds.get(n), (FractionalType, IntegralType))]
    if bad:
        raise ValueError(f"not numeric: {bad[:10]}")
    packed = F.array(*[finite(quoted(c)) for c in names]) if names else F.array().cast("array<double>")
    catalog = tuple(Feature(n, discrete=isinstance(kinds[n], IntegralType)) for n in names)
    return Wide(df.select(*_keys(df), packed.alias(FEATURES)), catalog)


def _positions(values: Sequence[int]) -> Column:
    return F.lit(list(map(int, values))).cast("array<int>")


def rebuilt(wide: Wide, parts: Sequence[Column], catalog: Sequence[Feature]) -> Wide:
    """The same rows with a new features array made of ``parts`` (arrays) in order."""
    arrays = [p for p in parts if p is not None]
    packed = F.concat(*arrays) if len(arrays) > 1 else (arrays[0] if arrays else F.array().cast("array<double>"))
    return Wide(wide.df.select(*_keys(wide.df), packed.alias(FEATURES)), tuple(catalog))


def bound(fn) -> Column:
    """``fn`` of the features array, which is evaluated once per row and then named.

    Steps follow one another as projections, and the optimiser merges them, so a features
    array that a lambda indexes would otherwise be rebuilt for every element it yields.
    The initial value of ``aggregate`` is evaluated once and bound to a lambda variable.
    """
    return F.aggregate(F.array(F.lit(0)), F.col(FEATURES), lambda acc, _: acc, fn)


def at(values: Column, p: Column) -> Column:
    return F.element_at(values, p + 1)


def taken(positions: Sequence[int]) -> Column | None:
    """The values at ``positions`` (0-based), in that order, as one expression."""
    if not positions:
        return None
    return bound(lambda x: F.transform(_positions(positions), lambda i: at(x, i)))


def keep(wide: Wide, positions: Sequence[int]) -> Wide:
    return rebuilt(wide, [taken(positions)], [wide.catalog[i] for i in positions])


# --- figures of all positions --------------------------------------------------------------


@dataclass(frozen=True)
class Figures:
    """Per position: non-null count, nulls, range, mean, population variance, sample sd."""

    n: np.ndarray
    n_null: np.ndarray
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    var_pop: np.ndarray
    sd: np.ndarray


def target_figures(wide: Wide, scope: str = "train") -> Figures:
    """The same figures of y, by the same pass."""
    rows = wide.df.filter(F.col(TARGET).isNotNull()) if scope == "train" else wide.df
    return figures(Wide(rows.select(F.array(F.col(TARGET).cast("double")).alias(FEATURES)),
                        (Feature(TARGET),)))


def figures(wide: Wide, scope: str = "all") -> Figures:
    """One numpy pass over all positions; only one row per position comes back."""
    rows = wide.df.filter(F.col(TARGET).isNotNull()) if scope == "train" else wide.df
    width = len(wide.catalog)
    if width == 0:
        empty = np.zeros(0)
        return Figures(empty, empty, empty, empty, empty, empty, empty)
    got = {r["idx"]: r for r in array_stats(rows, [str(i) for i in range(width)]).collect()}

    def column(name: str, missing: float = np.nan) -> np.ndarray:
        return np.array([missing if got[i][name] is None else got[i][name] for i in range(width)], dtype=float)

    return Figures(column("n", 0), column("n_null", 0), column("low"), column("high"), column("mean"),
                   column("var_pop"), column("sd"))


def seen(wide: Wide, positions: Sequence[int], k: int) -> np.ndarray:
    """Distinct finite values of each position, counted exactly up to ``k + 1``.

    A task keeps at most k + 1 values per position, so what moves is bounded by tasks x
    positions x (k + 1) whatever the rows.
    """
    if not positions:
        return np.zeros(0, dtype=int)
    width = len(positions)

    def bounded(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = [np.zeros(0) for _ in range(width)]
        for batch in batches:
            if not len(batch):
                continue
            x = dense(batch, width)
            for i in range(width):
                if len(held[i]) <= k:
                    column = x[:, i]
                    held[i] = np.unique(np.concatenate([held[i], column[np.isfinite(column)]]))[: k + 1]
        idx = np.concatenate([np.full(len(h), i, dtype=np.int32) for i, h in enumerate(held)])
        yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(np.concatenate(held))], names=["idx", "value"])

    rows = wide.df.select(taken(positions).alias(FEATURES)).coalesce(max_tasks(wide.df.sparkSession))
    counted = (rows.mapInArrow(bounded, "idx int, value double").groupBy("idx")
               .agg(F.count_distinct("value").alias("n")).collect())
    out = np.zeros(width, dtype=int)
    for r in counted:
        out[r["idx"]] = min(r["n"], k + 1)
    return out


# --- steps ---------------------------------------------------------------------------------


def varying(wide: Wide, scope: str = "all", whole: bool = True) -> Wide:
    """Positions with a sample sd above 0 (F1) and, with ``whole``, without a null."""
    f = figures(wide, scope)
    ok = (np.nan_to_num(f.sd, nan=0.0) > 0) & ((f.n_null == 0) if whole else True)
    return keep(wide, [i for i in range(len(wide.catalog)) if ok[i]])


def levels_of(wide: Wide, positions: Sequence[int], max_levels: int = MAX_LEVELS) -> dict[int, list[float]]:
    """Distinct values of discrete positions (bounded count first, so a key is refused by
    name before anything is gathered)."""
    if not positions:
        return {}
    counts = seen(wide, positions, max_levels)
    wide_ones = [wide.catalog[p].name for p, c in zip(positions, counts) if c > max_levels]
    if wide_ones:
        raise ValueError(f"more than {max_levels} levels, not one-hot encoded: {wide_ones}")
    long = wide.df.select(F.posexplode(taken(positions)).alias("i", "value")).filter("value is not null")
    out: dict[int, list[float]] = {p: [] for p in positions}
    for r in long.distinct().orderBy("i", "value").collect():
        out[positions[r["i"]]].append(r["value"])
    return out


def one_hot(wide: Wide, max_levels: int = MAX_LEVELS) -> Wide:
    """Discrete positions become 0/1 levels ``<name>_<value>`` after the others (E1); a null
    belongs to no level."""
    discrete = [i for i, f in enumerate(wide.catalog) if f.discrete]
    if not discrete:
        return wide
    levels = levels_of(wide, discrete, max_levels)
    places = [p for p in discrete for _ in levels[p]]
    values = [v for p in discrete for v in levels[p]]
    flags = None
    if places:
        flags = bound(lambda x: F.zip_with(_positions(places), F.lit(values).cast("array<double>"),
                                           lambda p, v: F.when(at(x, p) == v, 1.0).otherwise(0.0)))
    others = [i for i, f in enumerate(wide.catalog) if not f.discrete]
    catalog = [wide.catalog[i] for i in others] + [
        Feature(f"{wide.catalog[p].name}_{int(v)}", "level", (wide.catalog[p].name,), str(int(v)))
        for p, v in zip(places, values)]
    return rebuilt(wide, [taken(others), flags], catalog)


def _transform(code: Column, x: Column) -> Column:
    out = None
    for k, suffix in enumerate(SUFFIXES):
        out = (F.when(code == k, TRANSFORMS[suffix](x)) if out is None
               else out.when(code == k, TRANSFORMS[suffix](x)))
    return out


def nonlinear(wide: Wide, scope: str = "all") -> Wide:
    """For every raw continuous position, each transform whose gate its range opens,
    as ``<name>_<transform>`` after all positions; one expression for all of them."""
    raw = [i for i, f in enumerate(wide.catalog) if f.kind == "raw" and not f.discrete]
    f = figures(wide, scope)
    plan = [(i, s) for i in raw for s in open_gates(*(None if np.isnan(v) else float(v) for v in (f.low[i], f.high[i])))]
    if not plan:
        return wide
    made = bound(lambda x: F.zip_with(_positions([i for i, _ in plan]), _positions([SUFFIXES.index(s) for _, s in plan]),
                                      lambda p, code: _transform(code, at(x, p))))
    catalog = [*wide.catalog, *[Feature(f"{wide.catalog[i].name}_{s}", "transform", (wide.catalog[i].name,), s)
                                for i, s in plan]]
    return rebuilt(wide, [F.col(FEATURES), made], catalog)


def products(wide: Wide, pairs: Sequence[tuple[str, str]]) -> Wide:
    """``a*b`` for every pair of named positions, after all positions."""
    if not pairs:
        return wide
    place = {n: i for i, n in enumerate(wide.names)}
    missing = sorted({n for pair in pairs for n in pair if n not in place})
    if missing:
        raise ValueError(f"no such features: {missing[:10]}")
    made = bound(lambda x: F.zip_with(_positions([place[a] for a, _ in pairs]), _positions([place[b] for _, b in pairs]),
                                      lambda i, j: at(x, i) * at(x, j)))
    catalog = [*wide.catalog, *[Feature(f"{a}*{b}", "product", (a, b), "*") for a, b in pairs]]
    return rebuilt(wide, [F.col(FEATURES), made], catalog)


def from_names(wide: Wide, names: Sequence[str]) -> Wide:
    """The products named ``a*b`` in a saved list."""
    return products(wide, [tuple(n.split("*")) for n in names if n.count("*") == 1])


def standardize(wide: Wide, scope: str = "train") -> Wide:
    """Every position and y less their mean, over their population sd (0 becomes 1),
    both fitted on the rows with a target."""
    f, y = figures(wide, scope), target_figures(wide, scope)
    if np.isnan(y.mean).any():
        raise ValueError("no values to scale by: y")
    if np.isnan(f.mean).any():
        raise ValueError(f"no values to scale by: {[wide.names[i] for i in np.flatnonzero(np.isnan(f.mean))][:10]}")
    mean = [float(v) for v in f.mean]
    sd = [float(np.sqrt(v)) or 1.0 for v in f.var_pop]
    y_mean, y_sd = float(y.mean[0]), float(np.sqrt(y.var_pop[0])) or 1.0
    means, sds = F.lit(mean).cast("array<double>"), F.lit(sd).cast("array<double>")
    scaled = F.transform(F.col(FEATURES), lambda x, i: (x - at(means, i)) / at(sds, i))
    df = wide.df.select(ID, ((F.col(TARGET) - F.lit(y_mean)) / F.lit(y_sd)).alias(TARGET), scaled.alias(FEATURES))
    return Wide(df, wide.catalog, (*mean, y_mean), (*sd, y_sd))


def ks(wide: Wide, positions: Sequence[int]) -> DataFrame:
    """F4 over positions: idx, feature, n_test, n_train, n_unique, d, p_value.

    (position, value) pairs are counted per side before they move, then the running sums
    of the column form decide the largest gap.
    """
    spark = wide.df.sparkSession
    if not positions:
        return spark.createDataFrame([], "idx int, feature string, n_test long, n_train long, "
                                         "n_unique long, d double, p_value double")
    long = wide.df.select(F.col(TARGET).isNull().alias("is_test"),
                          F.posexplode(taken(positions)).alias("feature", "value"))
    sides = (long.filter("value is not null").groupBy("feature")
             .agg(F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train")))
    totals = {r["feature"]: (r["n_test"], r["n_train"]) for r in sides.collect()}
    table = spark.createDataFrame([(i, *totals.get(i, (0, 0))) for i in range(len(positions))],
                                  "feature int, n_test long, n_train long")
    n_rows = max((a + b for a, b in totals.values()), default=0)
    out = ks_of_long(long, table, n_rows)
    names = F.lit([wide.catalog[p].name for p in positions])
    return out.select(at(_positions(positions), F.col("feature")).alias("idx"),
                      at(names, F.col("feature")).alias("feature"),
                      "n_test", "n_train", "n_unique", "d", "p_value")


def screened(wide: Wide, alpha: float = 0.01, screen_on: str = "scaled", mode: str = "univariate"
             ) -> list[tuple[str, str]]:
    """E13 over all positions: pairs whose product passes the F test, in position order."""
    if len(wide.catalog) < 2:
        return []
    train = wide.df.filter(F.col(TARGET).isNotNull())
    f, y = figures(wide, "train"), target_figures(wide, "train")
    n = int(y.n[0])
    if (f.n != n).any():
        raise ValueError("positions with nulls: screen or fill them first")
    mean = np.nan_to_num(np.append(f.mean, y.mean))
    sd = np.sqrt(np.nan_to_num(np.append(f.var_pop, y.var_pop)))
    varies = np.append(f.low < f.high, y.low < y.high) & (n > 0)
    m = Matrix(train, tuple(wide.names))
    return screened_pairs(screen_products(m, n, mean, np.where(sd > 0, sd, 1.0), varies, alpha, mode, screen_on))


# --- profiles ------------------------------------------------------------------------------


def clean(df: DataFrame) -> Wide:
    """``clean_simple`` in array form: varying, complete positions, discrete ones one-hot."""
    require_varying_target(df)
    return one_hot(varying(widen(df)))


def non_linear(df: DataFrame) -> Wide:
    """Profile ``non_linear``: clean, gated transforms of the continuous positions, scaled."""
    return standardize(nonlinear(clean(df)))


def ks_filtered(df: DataFrame, alpha: float = 0.10, k: int = 3, pair_alpha: float = 0.01) -> Wide:
    """Profile ``ks_filtered``: clean; positions that vary, hold more than ``k`` values and
    whose test and train sides the distribution screen does not tell apart at ``alpha``;
    raw products of those whose scaled product passes at ``pair_alpha``; scaled."""
    wide = varying(clean(df))
    many = seen(wide, list(range(len(wide.catalog))), k)
    candidates = [i for i in range(len(wide.catalog)) if many[i] > k]
    passed = {r["idx"] for r in ks(wide, candidates).filter(F.col("p_value") > alpha).select("idx").collect()}
    kept = keep(wide, [i for i in candidates if i in passed])
    return standardize(products(kept, screened(kept, pair_alpha, "scaled")))


def feature_sums(wide: Wide) -> DataFrame:
    """feature, n (non-null values), total (their sum) per position: one aggregate."""
    long = wide.df.select(F.posexplode(F.col(FEATURES)).alias("i", "value"))
    sums = long.groupBy("i").agg(F.count("value").alias("n"), F.sum("value").alias("total"))
    names = F.lit(wide.names) if wide.names else F.array().cast("array<string>")
    return sums.select(F.element_at(names, F.col("i") + 1).alias("feature"), "n", "total")

