"""Model specs (U2): a recipe, where the features come from, and an estimator."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from descry.operators.linear import (Fit, LinearModel, Loss, fit_gram, fit_reweighted, fold_models,
                                     train_matrix)
from descry.operators.blocks import Matrix
from descry.operators.moments import correlation_edges
from descry.operators.profile import feature_names, select_k
from descry.operators.search import correlation_groups
from descry.plans.recipes import Prepared, Recipe, recipe


class Estimator(Protocol):
    """What validation needs: one fit, and all fits with a fold held out."""

    def fit(self, m: Matrix) -> LinearModel: ...

    def fit_folds(self, m: Matrix, repeats: int, n_splits: int
                  ) -> dict[tuple[int, int], LinearModel]: ...


@dataclass(frozen=True)
class Reweighted:
    """Support-vector and Huber models; all folds are fitted in the same passes."""

    loss: Loss
    tol: float = 1e-3

    def fit(self, m: Matrix) -> LinearModel:
        return fit_reweighted(m, [Fit(tuple(range(len(m.names))))], self.loss, self.tol)[0]

    def fit_folds(self, m, repeats, n_splits):
        keys = [(r, f) for r in range(repeats) for f in range(n_splits)]
        cols = tuple(range(len(m.names)))
        models = fit_reweighted(m, [Fit(cols, k) for k in keys], self.loss, self.tol)
        return dict(zip(keys, models, strict=True))


@dataclass(frozen=True)
class LeastSquares:
    """Ordinary, ridge or lasso; all folds come from one pass."""

    alpha: float = 0.0
    l1: float = 0.0

    def fit(self, m: Matrix) -> LinearModel:
        return fit_gram(m, self.alpha, self.l1)

    def fit_folds(self, m, repeats, n_splits):
        return fold_models(m, repeats, n_splits, self.alpha, self.l1)


def linear_svr_estimator(c: float = 1.0) -> Reweighted:
    return Reweighted(Loss("absolute", c))


def all_features(prepared: Prepared) -> list[str]:
    return prepared.names


def listed_features(names: Sequence[str]) -> Callable[[Prepared], list[str]]:
    return lambda prepared: list(names)


def group_representatives(threshold: float = 0.91) -> Callable[[Prepared], list[str]]:
    """The first listed column of each correlation group of the train rows."""

    def select(prepared: Prepared) -> list[str]:
        names = prepared.names
        edges = correlation_edges(prepared.train, names, threshold)
        pairs = [(r["feature_a"], r["feature_b"]) for r in edges.collect()]
        order = {n: i for i, n in enumerate(names)}
        firsts = {g[0] for g in correlation_groups(names, pairs)}
        return sorted(firsts, key=order.__getitem__)

    return select


def widest(k: int = 5) -> Callable[[Prepared], list[str]]:
    """The ``k`` columns of largest variance over the train rows."""

    def select(prepared: Prepared) -> list[str]:
        return feature_names(select_k(prepared.train, prepared.names, k))

    return select


@dataclass(frozen=True)
class ModelSpec:
    name: str
    recipe: Recipe
    estimator: Estimator
    select: Callable[[Prepared], list[str]] = field(default=all_features)


def model(name: str, features: Sequence[str] = (), base: Sequence[str] = ()) -> ModelSpec:
    """A registered spec. ``features`` is the saved list a list-driven model uses, ``base``
    the list whose products are screened first."""
    specs = {
        "mixed_stepwise": lambda: ModelSpec(
            name, recipe("step_interactions", base or features), linear_svr_estimator(),
            listed_features(features)),
        "best_svr": lambda: ModelSpec(
            name, recipe("best_list", features), linear_svr_estimator(), listed_features(features)),
        "correlation_grouper": lambda: ModelSpec(
            name, recipe("non_linear"), linear_svr_estimator(0.05), group_representatives()),
        "linear_svr": lambda: ModelSpec(
            name, recipe("non_linear"), Reweighted(Loss("squared", 1.0))),
        "linear_reg": lambda: ModelSpec(name, recipe("interactions"), LeastSquares()),
        "sgd": lambda: ModelSpec(
            name, recipe("reduced"), Reweighted(Loss("huber", eps=0.1, alpha=0.15)), widest(5)),
        "template": lambda: ModelSpec(name, recipe("simple"), linear_svr_estimator()),
    }
    if name not in specs:
        raise ValueError(f"no model {name}; there are {sorted(specs)}")
    return specs[name]()


