"""Least squares and ridge (R4, R5) for more columns than a Gram matrix on the driver holds.

The normal equations (S + alpha I) w = c, with S = Xc'Xc and c = Xc'yc over centred rows with a
target, are solved by conjugate gradients preconditioned by the diagonal of S. The matrix S is
never formed: every step is one pass in which each task adds Xc'(Xc p) over its rows for the
current direction p, so what moves is one column-sized vector per task, added up by the
cluster when there are many. The driver holds a few column-sized vectors.

Least squares without a penalty converges to the solution of least norm in the scaled
columns, as the Gram path's pseudo-inverse does; columns that do not vary get 0. The fit
reports its residual ||c - (S + alpha I) w|| / ||c||, recomputed by one last pass, and whether
it reached ``tol`` within ``max_passes``.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from descry import FEATURES, TARGET
from descry.operators.blocks import Matrix, dense, gather_sums, values_of
from descry.operators.linear import LinearModel, require_whole
from descry.session import max_tasks


def _sums(rows, width: int, tasks: int) -> np.ndarray:
    """n, sum y, then per column: sum x, sum x^2, sum x y (one pass)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        acc = np.zeros(2 + 3 * width)
        for batch in batches:
            if len(batch):
                x, y = dense(batch, width), values_of(batch, TARGET)
                acc += np.concatenate([[len(batch), y.sum()], x.sum(0), (x * x).sum(0), x.T @ y])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([acc], pa.list_(pa.float64()))],
                                         names=["key", "sums"])

    parts = rows.mapInArrow(run, "key int, sums array<double>")
    return gather_sums(parts, ["key"], tasks, 2 + 3 * width)[(0,)]


def _product(rows, mean: np.ndarray, live: np.ndarray, p: np.ndarray, tasks: int) -> np.ndarray:
    """Xc'(Xc p) over the live columns, one pass."""
    width = len(mean)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        acc = np.zeros(int(live.sum()))
        for batch in batches:
            if len(batch):
                xc = dense(batch, width)[:, live] - mean[live]
                acc += xc.T @ (xc @ p)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([acc], pa.list_(pa.float64()))],
                                         names=["key", "sums"])

    parts = rows.mapInArrow(run, "key int, sums array<double>")
    return gather_sums(parts, ["key"], tasks, int(live.sum()))[(0,)]


def fit_cg(m: Matrix, alpha: float = 0.0, tol: float = 1e-10, max_passes: int = 1000) -> LinearModel:
    """Sum of squares + alpha ||w||^2 with a free intercept, over rows with a target."""
    width = len(m.names)
    tasks = max_tasks(m.df.sparkSession)
    rows = m.df.filter(F.col(TARGET).isNotNull()).select(FEATURES, TARGET)
    s = _sums(rows, width, tasks)
    n, y_sum = s[0], s[1]
    if n == 0:
        raise ValueError("no rows to fit")
    x_sum, x_sq, xy = s[2:2 + width], s[2 + width:2 + 2 * width], s[2 + 2 * width:]
    require_whole([*m.names, TARGET], ~np.isfinite(np.append(x_sq, y_sum)))
    mean, y_mean = x_sum / n, y_sum / n
    diag = np.maximum(x_sq - n * mean * mean, 0.0)
    live = np.sqrt(diag / n) > 1e-9 * np.sqrt(np.maximum(x_sq, 1e-300) / n)
    w = np.zeros(width)
    passes, residual = 1, 0.0
    if live.any():
        c = xy[live] - n * mean[live] * y_mean
        scale = diag[live] + alpha  # the diagonal of S + alpha I
        v = np.zeros(len(c))
        r = c.copy()
        z = r / scale
        p, rz = z.copy(), r @ z
        norm_c = np.linalg.norm(c) or 1.0
        while np.linalg.norm(r) > tol * norm_c and passes < max_passes:
            q = _product(rows, mean, live, p, tasks) + alpha * p
            passes += 1
            step = rz / (p @ q)
            v += step * p
            r -= step * q
            z = r / scale
            rz, before = r @ z, rz
            p = z + (rz / before) * p
        true = c - _product(rows, mean, live, v, tasks) - alpha * v
        passes += 1
        residual = float(np.linalg.norm(true) / norm_c)
        w[live] = v
    return LinearModel(tuple(m.names), tuple(map(float, w)), float(y_mean - mean @ w), gap=residual,
                       passes=passes, converged=residual <= 10 * tol)
