"""Recipes (U1): clean, engineer, scale. Each is fitted once and yields lazy tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry import TARGET
from descry.operators.blocks import Matrix, matrix
from descry.operators.cleaning import (coerce_numeric, descriptor_columns, drop_infinite,
                                       fill_missing, pick, require_no_nulls,
                                       test_rows, train_rows)
from descry.operators.engineer import (combine_features, interaction_from_names,
                                       interaction_values, nonlinear_expand, nonlinear_plan,
                                       one_hot_integers)
from descry.operators.ks import ks_names
from descry.operators.moments import interaction_screen, screened_pairs
from descry.operators.profile import (column_stats, distinct_beyond, feature_names,
                                      require_varying_target)
from descry.operators.scaling import Scaler, fit_scaler, standardize
from descry.operators.trees import pca, spread


@dataclass(frozen=True)
class Prepared:
    """A prepared table (id, y, features) in model units, and the scaler to leave them."""

    df: DataFrame
    scaler: Scaler = field(default_factory=Scaler.identity)

    @property
    def names(self) -> list[str]:
        return descriptor_columns(self.df)

    @property
    def train(self) -> DataFrame:
        return train_rows(self.df)

    @property
    def test(self) -> DataFrame:
        return test_rows(self.df)

    def matrix(self, names: Sequence[str] | None = None) -> Matrix:
        return matrix(self.df, self.names if names is None else list(names))

    def invert(self, value):
        """Target units from model units."""
        if isinstance(value, (int, float)):
            if TARGET not in self.scaler.mean:
                return value
            return value * self.scaler.sd[TARGET] + self.scaler.mean[TARGET]
        return self.scaler.invert(TARGET, value)

    def cut(self, value: float) -> float:
        return self.scaler.cut(value)


def _varying(df: DataFrame, scope: str = "all", whole: bool = True) -> list[str]:
    names = descriptor_columns(df)
    rows = train_rows(df) if scope == "train" else df
    kept = column_stats(rows, names).filter("sd > 0")
    return feature_names(kept.filter("n_null = 0") if whole else kept)


def clean_simple(df: DataFrame) -> DataFrame:
    """Varying, complete columns; integer columns one-hot encoded; no infinities left."""
    require_varying_target(df)
    kept = pick(df, _varying(drop_infinite(df)))
    return require_no_nulls(one_hot_integers(kept))


def clean_numeric(df: DataFrame) -> DataFrame:
    """Text to numbers, varying columns, holes filled with 0."""
    require_varying_target(df)
    numbers = drop_infinite(coerce_numeric(df))
    return fill_missing(pick(numbers, _varying(numbers, whole=False)))


def unchanged(df: DataFrame) -> DataFrame:
    return df


def scale_all(df: DataFrame) -> Prepared:
    scaler = fit_scaler(df, [*descriptor_columns(df), TARGET])
    return Prepared(standardize(df, scaler), scaler)


def scale_nothing(df: DataFrame) -> Prepared:
    return Prepared(df)


def scale_target(df: DataFrame) -> Prepared:
    scaler = fit_scaler(df, [TARGET])
    return Prepared(standardize(df, scaler), scaler)


def with_listed_interactions(names: Sequence[str], alpha: float = 0.01,
                             screen_on: str = "scaled") -> Callable[[DataFrame], DataFrame]:
    """Adds raw products of the listed columns whose (scaled) product passes the F test."""

    def engineer(df: DataFrame) -> DataFrame:
        pairs = screened_pairs(interaction_screen(df, list(names), alpha, screen_on=screen_on))
        return interaction_values(df, pairs)

    return engineer


def with_all_interactions(df: DataFrame) -> DataFrame:
    """Significant raw products of all pairs beside the transforms."""
    names = descriptor_columns(df)
    pairs = screened_pairs(interaction_screen(df, names, 0.01, screen_on="raw"))
    return combine_features(df, nonlinear_plan(df), pairs)


def ks_engineer(alpha: float = 0.10, k: int = 3, pair_alpha: float = 0.01
                ) -> Callable[[DataFrame], DataFrame]:
    """Variance, cardinality and distribution screens, then products of what is left."""

    def engineer(df: DataFrame) -> DataFrame:
        names = _varying(df)
        many = distinct_beyond(df, names, k).filter(F.col("n_seen") > k)
        names = ks_names(df, feature_names(many), alpha)
        kept = pick(df, names)
        return with_listed_interactions(names, pair_alpha)(kept)

    return engineer


def reduce_columns(k: int = 100) -> Callable[[DataFrame], DataFrame]:
    def engineer(df: DataFrame) -> DataFrame:
        wide = nonlinear_expand(df)
        return spread(pca(wide, descriptor_columns(wide), k))

    return engineer


@dataclass(frozen=True)
class Recipe:
    """Three stages; any of them may be replaced by a function of the same kind."""

    name: str
    clean: Callable[[DataFrame], DataFrame] = clean_simple
    engineer: Callable[[DataFrame], DataFrame] = unchanged
    scale: Callable[[DataFrame], Prepared] = scale_all

    def prepare(self, df: DataFrame) -> Prepared:
        return self.scale(self.engineer(self.clean(df)))


def recipe(name: str, features: Sequence[str] = ()) -> Recipe:
    """A named profile; the two list-driven ones take the list's names."""
    recipes = {
        "simple": lambda: Recipe(name),
        "non_linear": lambda: Recipe(name, engineer=nonlinear_expand),
        "interactions": lambda: Recipe(name, clean_numeric, with_all_interactions, scale_nothing),
        "step_interactions": lambda: Recipe(name, engineer=with_listed_interactions(features)),
        "ks_filtered": lambda: Recipe(name, engineer=ks_engineer()),
        "best_list": lambda: Recipe(
            name, engineer=lambda df: interaction_from_names(df, features)),
        "reduced": lambda: Recipe(name, engineer=reduce_columns(), scale=scale_target),
    }
    if name not in recipes:
        raise ValueError(f"no recipe {name}; there are {sorted(recipes)}")
    return recipes[name]()


