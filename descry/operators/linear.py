"""Linear models from summed moments (R1-R9, R14): rows are only ever added up.

Squared-loss models need one pass. The others are reweighted least squares: each pass adds
up weighted moments of all models at once, and the driver solves systems of column size.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry import FEATURES, ID, TARGET
from descry.functions.columns import balanced_sum, dot, quoted
from descry.operators.blocks import (STATE, Matrix, add_up, dense, gather_sums, sums_batch,
                                     values_of)
from descry.session import max_tasks

FOLDS = "folds"


@dataclass(frozen=True)
class LinearModel:
    """Coefficients by feature name. ``gap`` is the relative duality gap where known;
    ``converged`` is false if the fit stopped at its greatest number of passes."""

    names: tuple[str, ...]
    coef: tuple[float, ...]
    intercept: float
    gap: float | None = None
    passes: int = 1
    converged: bool = True

    def column(self) -> Column:
        """Prediction from wide columns."""
        terms = [quoted(n).cast("double") * F.lit(float(w))
                 for n, w in zip(self.names, self.coef, strict=True)]
        return balanced_sum([*terms, F.lit(float(self.intercept))])

    def array_column(self, names: Sequence[str]) -> Column:
        """Prediction from the array column of a matrix with these names."""
        weights = dict(zip(self.names, self.coef, strict=True))
        return dot(F.col(FEATURES), [weights.get(n, 0.0) for n in names]) + F.lit(self.intercept)

    def coefficients(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(n, float(w)) for n, w in zip(self.names, self.coef, strict=True)],
            "feature string, coef double")


@dataclass(frozen=True)
class Fit:
    """One model to fit: feature positions, and the (repeat, fold) held out if any."""

    cols: tuple[int, ...]
    held_out: tuple[int, int] | None = None


@dataclass(frozen=True)
class Loss:
    """``absolute`` and ``squared``: ||w||^2/2 + C sum(loss(|r| - eps)), intercept penalised.
    ``huber``: mean Huber loss of width eps + alpha ||w||_1, intercept free."""

    kind: str
    c: float = 1.0
    eps: float = 0.0
    alpha: float = 0.0


def require_whole(names: Sequence[str], missing: np.ndarray) -> None:
    """Fits refuse missing features: one would spoil every sum without a sign."""
    bad = [n for n, x in zip(names, missing, strict=True) if x]
    if bad:
        raise ValueError(f"missing or infinite values, fill or drop them before fitting: {bad[:20]}")


def train_matrix(m: Matrix) -> Matrix:
    return replace(m, df=m.df.filter(F.col(TARGET).isNotNull()))


def _fold_matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(FOLDS))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def _gram_partials(m: Matrix, repeats: int, n_splits: int) -> tuple[DataFrame, int, int]:
    """Per task and fold the moments of (1, features, y) flattened; the number of tasks, and
    of doubles each may emit. Folds are split over passes when a task could not hold all."""
    width = len(m.names)
    size = (width + 2) ** 2
    if size * 8 > STATE:
        raise ValueError(f"{width} columns: screen or group them before fitting")
    tasks = max_tasks(m.df.sparkSession)
    cols = [FEATURES, TARGET] + ([FOLDS] if repeats else [])
    rows = m.df.select(*cols).coalesce(tasks)
    jobs = [(r, f) for r in range(repeats) for f in range(n_splits)] or [(0, 0)]
    per_pass = max(1, STATE // (size * 8))

    def one_pass(chunk):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                if not len(batch):
                    continue
                z = np.column_stack(
                    [np.ones(len(batch)), dense(batch, width), values_of(batch, TARGET)])
                if not repeats:
                    gram = z.T @ z
                    total[0, 0] = total[0, 0] + gram if (0, 0) in total else gram
                    continue
                folds = _fold_matrix(batch)
                for r in sorted({r for r, _ in chunk}):
                    # rows in fold order once per repeat: one Gram per run, whatever the folds
                    order = np.argsort(folds[:, r], kind="stable")
                    held = folds[order, r]
                    wanted = np.array(sorted(f for q, f in chunk if q == r))
                    starts = np.searchsorted(held, wanted, side="left")
                    ends = np.searchsorted(held, wanted, side="right")
                    for f, a, b in zip(wanted.tolist(), starts.tolist(), ends.tolist()):
                        if b > a:
                            part = z[order[a:b]]
                            gram = part.T @ part
                            total[r, f] = total[r, f] + gram if (r, f) in total else gram
            if total:
                yield sums_batch({"repeat": [k[0] for k in total], "fold": [k[1] for k in total]},
                                 list(total.values()))
        return run

    out = None
    for start in range(0, len(jobs), per_pass):
        part = rows.mapInArrow(one_pass(jobs[start : start + per_pass]),
                               "repeat int, fold int, sums array<double>")
        out = part if out is None else out.unionByName(part)
    return out, tasks, size * len(jobs)


def grams(m: Matrix, repeats: int = 0, n_splits: int = 0) -> DataFrame:
    """(repeat, fold, sums): moments per fold; without folds one row (0, 0)."""
    parts, tasks, _ = _gram_partials(m, repeats, n_splits)
    return add_up(parts, ["repeat", "fold"], tasks)


def collect_grams(m: Matrix, repeats: int = 0, n_splits: int = 0
                  ) -> dict[tuple[int, int], np.ndarray]:
    """The same as square matrices on the driver."""
    parts, tasks, size = _gram_partials(m, repeats, n_splits)
    width = len(m.names) + 2
    found = gather_sums(parts, ["repeat", "fold"], tasks, size)
    if not found:
        raise ValueError("no rows to fit")
    out = {k: v.reshape(width, width) for k, v in found.items()}
    ends = sum(np.diag(g) for g in out.values())
    require_whole([*m.names, TARGET], ~np.isfinite(ends[1:]))
    return out


def solve_gram(g: np.ndarray, cols: Sequence[int], alpha: float = 0.0, l1: float = 0.0
               ) -> tuple[np.ndarray, float]:
    """Coefficients and free intercept for sum of squares + alpha ||w||^2, or for half the
    mean of squares + l1 ||w||_1. Works on columns centred and scaled from the sums; a column
    that does not vary gets 0."""
    idx = np.asarray(cols, dtype=int) + 1
    n = g[0, 0]
    mean, y_mean = g[0, idx] / n, g[0, -1] / n
    s = g[np.ix_(idx, idx)] - n * np.outer(mean, mean)
    c = g[idx, -1] - n * mean * y_mean
    spread = np.sqrt(np.maximum(np.diag(s), 0.0) / n)
    live = spread > 1e-9 * np.maximum(1e-300, np.sqrt(np.maximum(g[idx, idx], 0.0) / n))
    w = np.zeros(len(idx))
    if live.any():
        d = spread[live]
        a = s[np.ix_(live, live)] / np.outer(d, d)
        b = c[live] / d
        if l1:
            v = lasso_on_gram(a / n, b / n, l1 / d)
        elif alpha:
            v = np.linalg.solve(a + np.diag(alpha / d**2), b)
        else:
            v = np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b
        w[live] = v / d
    return w, float(y_mean - mean @ w)


def lasso_on_gram(a: np.ndarray, b: np.ndarray, penalty: np.ndarray, start=None,
                  rounds: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """min v'av/2 - b'v + sum(penalty |v|) by coordinate descent on column-sized state."""
    v = np.zeros(len(b)) if start is None else np.array(start, dtype=float)
    grad = a @ v - b
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(b)):
            if a[j, j] <= 0:
                continue
            z = v[j] * a[j, j] - grad[j]
            new = np.sign(z) * max(abs(z) - penalty[j], 0.0) / a[j, j]
            step = new - v[j]
            if step:
                grad += a[:, j] * step
                v[j] = new
                moved = max(moved, abs(step) * np.sqrt(a[j, j]))
        if moved < tol:
            break
    return v


SOLVED = ("repeat int, fold int, alpha double, coef array<double>, intercept double, sse double, "
          "n double, sst double, missing array<int>")


def fold_table(m: Matrix, repeats: int = 0, n_splits: int = 0) -> DataFrame:
    """(repeat, fold, sums, rest): the moments of each fold's train rows and of the rows a
    model for that fold learns from (its repeat's total less the fold), added up by the
    cluster; without folds one row whose ``rest`` is all train rows."""
    parts, tasks, _ = _gram_partials(train_matrix(m), repeats, n_splits)
    per_fold = add_up(parts, ["repeat", "fold"], tasks)
    if not repeats:
        return per_fold.withColumn("rest", F.col("sums"))
    totals = add_up(per_fold.select("repeat", "sums"), ["repeat"], n_splits).withColumnRenamed("sums", "total")
    less = F.zip_with("total", "sums", lambda t, g: t - g)
    return per_fold.join(totals, "repeat").select("repeat", "fold", "sums", less.alias("rest"))


def solved_folds(m: Matrix, repeats: int = 0, n_splits: int = 0, alphas: Sequence[float] = (0.0,),
                 l1: float = 0.0) -> DataFrame:
    """One row per fold and penalty, solved in the task that holds the fold's moments:
    coefficients, intercept, the fold's sum of squared errors, rows and total sum of squares,
    and the positions of features with missing or infinite values (which spoil every sum)."""
    width = len(m.names)
    cols = range(width)
    side = width + 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(len(batch)):
                g = batch.column(2)[k].values.to_numpy(zero_copy_only=False).reshape(side, side)
                rest = batch.column(3)[k].values.to_numpy(zero_copy_only=False).reshape(side, side)
                bad = np.flatnonzero(~np.isfinite(np.diag(rest)[1:])).astype(np.int32)
                key = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                for alpha in alphas:
                    if len(bad):
                        rows.append((*key, float(alpha), np.zeros(width), 0.0, 0.0, 0.0, 0.0, bad))
                        continue
                    w, b = solve_gram(rest, cols, alpha, l1)
                    n = g[0, 0]
                    sst = g[-1, -1] - g[0, -1] ** 2 / n if n else 0.0
                    rows.append((*key, float(alpha), w, b, fold_error(g, cols, w, b), n, sst, bad))
            if rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                    *[pa.array([r[i] for r in rows], pa.float64()) for i in (2,)],
                    pa.array([np.asarray(r[3], dtype=float) for r in rows], pa.list_(pa.float64())),
                    *[pa.array([float(r[i]) for r in rows], pa.float64()) for i in (4, 5, 6, 7)],
                    pa.array([r[8] for r in rows], pa.list_(pa.int32()))],
                    names=["repeat", "fold", "alpha", "coef", "intercept", "sse", "n", "sst", "missing"])

    return fold_table(m, repeats, n_splits).mapInArrow(run, SOLVED)


def fold_models(m: Matrix, repeats: int = 0, n_splits: int = 0, alpha: float = 0.0, l1: float = 0.0
                ) -> dict[tuple[int, int], LinearModel]:
    """Models per (repeat, fold), solved in tasks; only their coefficients reach the driver."""
    found = solved_folds(m, repeats, n_splits, (alpha,), l1).select(
        "repeat", "fold", "coef", "intercept", "missing").collect()
    if not found:
        raise ValueError("no rows to fit")
    bad = sorted({i for r in found for i in r["missing"]})
    require_whole([*m.names, TARGET], [i in bad for i in range(len(m.names) + 1)])
    return {(r["repeat"], r["fold"]): LinearModel(m.names, tuple(r["coef"]), r["intercept"]) for r in found}


def fit_gram(m: Matrix, alpha: float = 0.0, l1: float = 0.0) -> LinearModel:
    """Least squares (defaults), ridge (``alpha``) or lasso (``l1``) in one pass; the system
    is solved in the task that adds up the moments.

    Beyond the columns whose Gram matrix a task may hold, least squares and ridge go to
    conjugate gradients over passes (``solver.fit_cg``); lasso is refused there.
    """
    if not l1 and (len(m.names) + 2) ** 2 * 8 > STATE:
        from descry.operators.solver import fit_cg

        return fit_cg(m, alpha)
    return fold_models(m, alpha=alpha, l1=l1)[0, 0]


def fold_solutions(fold_grams: dict[tuple[int, int], np.ndarray], cols: Sequence[int],
                   alpha: float = 0.0, l1: float = 0.0
                   ) -> dict[tuple[int, int], tuple[np.ndarray, float]]:
    """Per held-out fold: the solution on the rest, as total minus the fold."""
    repeats = {r for r, _ in fold_grams}
    total = {r: sum(g for (q, _), g in fold_grams.items() if q == r) for r in repeats}
    return {k: solve_gram(total[k[0]] - g, cols, alpha, l1) for k, g in fold_grams.items()}


def fold_error(g: np.ndarray, cols: Sequence[int], w: np.ndarray, b: float) -> float:
    """Sum of squared errors on a fold from its moments alone."""
    idx = np.concatenate([[0], np.asarray(cols, dtype=int) + 1])
    beta = np.concatenate([[b], w])
    sse = g[-1, -1] - 2 * beta @ g[idx, -1] + beta @ g[np.ix_(idx, idx)] @ beta
    return float(max(sse, 0.0))


def ridge_grid(m: Matrix, repeats: int, n_splits: int,
               alphas: Sequence[float] = (1.0, 2.0, 5.0, 10.0, 200.0)) -> DataFrame:
    """(alpha, rmse, r2): means over folds for each ridge penalty, all from one pass."""
    solved = solved_folds(m, repeats, n_splits, alphas)
    check = solved.select(F.explode("missing").alias("i")).distinct().collect()
    require_whole([*m.names, TARGET], [i in {r["i"] for r in check} for i in range(len(m.names) + 1)])
    return (solved.groupBy("alpha")
            .agg(F.avg(F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"), F.avg(1 - F.col("sse") / F.col("sst")).alias("r2"))
            .orderBy("alpha"))


def best_ridge(m: Matrix, repeats: int, n_splits: int,
               alphas: Sequence[float] = (1.0, 2.0, 5.0, 10.0, 200.0)) -> tuple[LinearModel, float]:
    """The ridge model, fitted on all train rows, whose penalty had the best mean R^2."""
    top = ridge_grid(m, repeats, n_splits, alphas).orderBy(F.desc("r2"), "alpha").first()
    return fit_gram(m, top["alpha"]), top["alpha"]


def _reweight(r: np.ndarray, y: np.ndarray, loss: Loss, delta: float | None):
    """(weight, weighted target, loss, smoothed loss, dual value) of each row at residual r.

    The normal equations of weight and target give the next step: a Newton step of the loss
    with its corner rounded to width ``delta`` (absolute), of the loss itself (squared), or
    the minimum of a quadratic above the loss (Huber).
    """
    if delta is None:
        return np.ones_like(r), y, np.abs(r), np.abs(r), np.zeros_like(r)
    if loss.kind == "huber":
        size = np.abs(r)
        value = np.where(size <= loss.eps, 0.5 * r * r, loss.eps * size - 0.5 * loss.eps**2)
        w = loss.eps / np.maximum(size, loss.eps)
        return w, w * y, value, value, np.zeros_like(r)
    if loss.kind == "squared":
        over = np.maximum(np.abs(r) - loss.eps, 0.0)
        w = 2.0 * (np.abs(r) >= loss.eps)
        value = over * over
        return w, w * (y - loss.eps * np.sign(r)), value, value, np.zeros_like(r)
    # max(0, |r| - eps) is the mean of |r - eps| and |r + eps|, less eps
    value, smooth, weight, target, dual = -loss.eps, -loss.eps, 0.0, 0.0, 0.0
    for shift in (-loss.eps, loss.eps):
        u = r + shift
        size = np.abs(u)
        inside = size <= delta
        value = value + 0.5 * size
        smooth = smooth + 0.5 * np.where(inside, u * u / (2 * delta), size - delta / 2)
        weight = weight + 0.5 * inside / delta
        target = target + 0.5 * np.where(inside, (y + shift) / delta, np.sign(u))
        dual = dual + 0.5 * np.clip(u / delta, -1.0, 1.0)
    return weight, target, value, smooth, dual


def _weighted_pass(rows: DataFrame, width: int, fits: Sequence[Fit], weights: list[np.ndarray],
                   loss: Loss, deltas: list[float | None], live: Sequence[int]
                   ) -> dict[int, dict]:
    """Weighted moments of the live models at their current weights, summed over all rows."""
    has_folds = any(f.held_out for f in fits)
    sizes = {i: (len(fits[i].cols) + 1) for i in live}
    chunks: list[list[int]] = [[]]
    held = 0
    for i in live:
        need = 8 * (sizes[i] ** 2 + 3 * sizes[i])
        if chunks[-1] and held + need > STATE:
            chunks.append([])
            held = 0
        chunks[-1].append(i)
        held += need

    def one_pass(chunk):
        picked = [(i, np.array(fits[i].cols, dtype=int), fits[i].held_out, weights[i], deltas[i])
                  for i in chunk]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                if not len(batch):
                    continue
                x, y_all = dense(batch, width), values_of(batch, TARGET)
                folds = _fold_matrix(batch) if has_folds else None
                ones = np.ones((len(batch), 1))
                for i, cols, held_out, w, delta in picked:
                    z, y = np.hstack([ones, x[:, cols]]), y_all
                    if held_out is not None:
                        keep = folds[:, held_out[0]] != held_out[1]
                        z, y = z[keep], y[keep]
                    r = y - z @ w
                    omega, target, value, smooth, dual = _reweight(r, y, loss, delta)
                    part = np.concatenate([
                        (z.T @ (z * omega[:, None])).ravel(), z.T @ target, z.T @ dual,
                        [value.sum(), smooth.sum(), np.abs(r).sum(), float(dual @ y),
                         np.abs(dual).sum(), len(y)]])
                    total[i] = total[i] + part if i in total else part
            if total:
                yield sums_batch({"fit": list(total)}, list(total.values()))
        return run

    out = {}
    tasks = max_tasks(rows.sparkSession)
    for chunk in chunks:
        parts = rows.mapInArrow(one_pass(chunk), "fit int, sums array<double>")
        size = sum(sizes[i] ** 2 + 2 * sizes[i] + 6 for i in chunk)
        for (fit,), v in gather_sums(parts, ["fit"], tasks, size).items():
            k = sizes[fit]
            out[fit] = {
                "a": v[: k * k].reshape(k, k), "b": v[k * k : k * k + k],
                "dual": v[k * k + k : k * k + 2 * k],
                **dict(zip(("loss", "smooth", "abs", "dual_y", "dual_abs", "n"), v[k * k + 2 * k :],
                           strict=True))}
    return out


def _next_weights(s: dict, loss: Loss, w: np.ndarray) -> np.ndarray:
    if loss.kind != "huber":
        return np.linalg.solve(np.eye(len(w)) + loss.c * s["a"], loss.c * s["b"])
    penalty = np.full(len(w), loss.alpha)
    penalty[0] = 0.0
    return lasso_on_gram(s["a"] / s["n"], s["b"] / s["n"], penalty, start=w)


@dataclass
class _Search:
    """Where the fit of one model stands."""

    w: np.ndarray
    delta: float | None = None
    base: tuple[np.ndarray, float] | None = None  # last accepted weights, smoothed objective
    best: tuple[float, np.ndarray] | None = None
    bound: float = -np.inf
    passes: int = 0
    done: bool = False

    def start(self, s: dict, loss: Loss) -> None:
        self.w = _next_weights(s, loss, self.w)
        self.delta = 0.5 * s["abs"] / s["n"] or 1.0

    def update(self, s: dict, loss: Loss, tol: float) -> None:
        w = self.w
        if loss.kind == "huber":
            value = smooth = s["loss"] / s["n"] + loss.alpha * np.abs(w[1:]).sum()
        else:
            value = 0.5 * w @ w + loss.c * s["loss"]
            smooth = 0.5 * w @ w + loss.c * s["smooth"]
        if self.best is None or value < self.best[0]:
            self.best = (value, w)
        if loss.kind == "absolute":
            v = loss.c * s["dual"]
            self.bound = max(self.bound, -0.5 * v @ v + loss.c * s["dual_y"]
                             - loss.eps * loss.c * s["dual_abs"])
            if self.best[0] - self.bound <= tol * abs(self.best[0]):
                self.done = True
                return
        if self.base is not None and smooth > self.base[1] + 1e-12 * abs(self.base[1]):
            step = w - self.base[0]
            if np.abs(step).max() <= 1e-12 * (1.0 + np.abs(w).max()):
                self.done = True
            self.w = self.base[0] + 0.5 * step  # the step overshot: halve it
            return
        following = _next_weights(s, loss, w)
        if loss.kind == "huber":
            self.done = (self.base is not None
                         and self.base[1] - smooth <= 1e-3 * tol * max(abs(smooth), 1e-12))
            self.base = (w, smooth)
        else:
            slope = (w + loss.c * (s["a"] @ w - s["b"])) @ (w - following)
            self.base = (w, smooth)
            if loss.kind == "squared":
                self.done = slope <= 1e-3 * tol * max(abs(smooth), 1e-12)
            elif 0.5 * np.sum((w - loss.c * s["dual"]) ** 2) <= 0.3 * tol * abs(value):
                # the gradient no longer holds the gap open, the width does: sharpen
                self.delta = min(0.3 * self.delta, s["abs"] / s["n"])
                self.base = None
        self.w = following


def missing_features(rows: DataFrame, width: int) -> np.ndarray:
    """Which positions of the features are missing or infinite in some row."""
    bad = F.transform(FEATURES, lambda x: (x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    found = rows.select(F.posexplode(bad)).filter("col").select("pos").distinct().collect()
    return np.isin(np.arange(width), [r["pos"] for r in found])


def fit_reweighted(m: Matrix, fits: Sequence[Fit], loss: Loss, tol: float = 1e-3,
                   max_passes: int = 500) -> list[LinearModel]:
    """Fits all models together, one pass over the rows per step; a finished model drops out.

    Absolute loss: damped Newton steps on a rounded corner that sharpens (Madsen and Nielsen
    1993) until the duality gap is within ``tol`` of the objective; the gap is reported.
    A model that needs more than ``max_passes`` says so by ``converged`` and a warning.
    """
    width = len(m.names)
    cols = [FEATURES, TARGET] + ([FOLDS] if any(f.held_out for f in fits) else [])
    rows = train_matrix(m).df.select(*cols).coalesce(max_tasks(m.df.sparkSession)).persist()
    try:
        states = [_Search(np.zeros(len(f.cols) + 1)) for f in fits]
        live = list(range(len(fits)))
        for step in range(max_passes):
            sums = _weighted_pass(rows, width, fits, [s.w for s in states], loss,
                                  [s.delta for s in states], live)
            for i in live:
                if i not in sums:
                    raise ValueError("a model has no rows to fit")
                if step == 0 and not np.isfinite(sums[i]["abs"]):
                    require_whole(m.names, missing_features(rows, width))
                states[i].passes += 1
                if step == 0:
                    states[i].start(sums[i], loss)
                else:
                    states[i].update(sums[i], loss, tol)
            live = [i for i in live if not states[i].done]
            if not live:
                break
    finally:
        rows.unpersist()
    out = []
    for f, s in zip(fits, states, strict=True):
        value, w = s.best
        gap = (value - s.bound) / max(abs(value), 1e-300) if loss.kind == "absolute" else None
        out.append(LinearModel(tuple(m.names[c] for c in f.cols), tuple(map(float, w[1:])),
                               float(w[0]), None if gap is None else float(gap), s.passes, s.done))
    if live:
        warnings.warn(f"{len(live)} of {len(fits)} models stopped after {max_passes} passes",
                      RuntimeWarning, stacklevel=2)
    return out


def linear_svr(m: Matrix, c: float = 1.0, eps: float = 0.0, tol: float = 1e-3) -> LinearModel:
    """Linear support-vector regression, absolute loss beyond ``eps``."""
    return fit_reweighted(m, [Fit(tuple(range(len(m.names))))], Loss("absolute", c, eps), tol)[0]


def linear_svr_squared(m: Matrix, c: float = 1.0, eps: float = 0.0) -> LinearModel:
    """The same with squared loss."""
    return fit_reweighted(m, [Fit(tuple(range(len(m.names))))], Loss("squared", c, eps))[0]


def huber_l1(m: Matrix, alpha: float = 0.15, eps: float = 0.1) -> LinearModel:
    """Mean Huber loss with an L1 penalty."""
    return fit_reweighted(m, [Fit(tuple(range(len(m.names))))], Loss("huber", 1.0, eps, alpha))[0]


def predict_folds(m: Matrix, models: dict[tuple[int, int], LinearModel], repeats: int,
                  n_splits: int) -> DataFrame:
    """(id, repeat, fold, actual, prediction): every row by the models that held it out.

    Each row is multiplied by the weights of its own folds only, so many splits cost no more.
    """
    position = {n: i for i, n in enumerate(m.names)}
    w = np.zeros((len(m.names) + 1, repeats * n_splits))
    for (r, f), model in models.items():
        w[0, r * n_splits + f] = model.intercept
        for n, v in zip(model.names, model.coef, strict=True):
            w[position[n] + 1, r * n_splits + f] = v

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = dense(batch, w.shape[0] - 1)
            folds = _fold_matrix(batch)[:, :repeats]
            which = folds + np.arange(repeats) * n_splits
            # each row meets only the weights of the models that held it out
            preds = np.einsum("ij,jik->ik", x, w[1:, which]) + w[0, which]
            ids = batch.column(batch.schema.get_field_index(ID))
            rows = pa.array(np.repeat(np.arange(n), repeats))
            yield pa.RecordBatch.from_pydict({
                ID: ids.take(rows),
                "repeat": pa.array(np.tile(np.arange(repeats, dtype=np.int32), n)),
                "fold": pa.array(folds.ravel().astype(np.int32)),
                "actual": batch.column(batch.schema.get_field_index(TARGET)).take(rows),
                "prediction": pa.array(preds.ravel())})

    id_type = m.df.schema[ID].dataType.simpleString()
    return train_matrix(m).df.select(ID, TARGET, FEATURES, FOLDS).mapInArrow(
        run, f"{ID} {id_type}, repeat int, fold int, actual double, prediction double")


def predict(df: DataFrame, model: LinearModel, invert=None) -> DataFrame:
    """Adds ``prediction`` from wide columns, in target units when given an inverse."""
    value = model.column()
    return df.withColumn("prediction", value if invert is None else invert(value))
