"""Scaler state and its use."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from descry import TARGET
from descry.functions.columns import quoted
from descry.operators.cleaning import train_rows
from descry.operators.profile import column_stats


@dataclass(frozen=True)
class Scaler:
    """Mean and population sd per column. A column it does not know passes unchanged, so
    the empty scaler is the identity."""

    mean: dict[str, float] = field(default_factory=dict)
    sd: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def identity() -> Scaler:
        return Scaler()

    def scale(self, name: str, value: Column | None = None) -> Column:
        value = quoted(name) if value is None else value
        if name not in self.mean:
            return value
        return (value - F.lit(self.mean[name])) / F.lit(self.sd[name])

    def invert(self, name: str, value: Column) -> Column:
        if name not in self.mean:
            return value
        return value * F.lit(self.sd[name]) + F.lit(self.mean[name])

    def cut(self, value: float, name: str = TARGET) -> float:
        """A target cut in scaled units."""
        if name not in self.mean:
            return value
        return (value - self.mean[name]) / self.sd[name]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(c, self.mean[c], self.sd[c]) for c in self.mean],
            "feature string, mean double, sd double",
        )


def fit_scaler(df: DataFrame, names: Sequence[str], scope: str = "train") -> Scaler:
    """One aggregate over the rows with a target (or all rows); a zero sd becomes 1."""
    if not names:
        return Scaler.identity()
    rows = train_rows(df) if scope == "train" else df
    mean, sd = {}, {}
    for r in column_stats(rows, list(names)).select("feature", "mean", "var_pop").collect():
        if r["mean"] is None:
            raise ValueError(f"no values to scale by: {r['feature']}")
        mean[r["feature"]] = r["mean"]
        sd[r["feature"]] = (r["var_pop"] ** 0.5) or 1.0
    return Scaler(mean, sd)


def standardize(df: DataFrame, scaler: Scaler) -> DataFrame:
    """Scales the columns the scaler knows; constants enter the projection as literals."""
    return df.select(*[scaler.scale(c).alias(c) for c in df.columns])
