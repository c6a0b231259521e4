"""Least squares beyond the Gram limit: conjugate gradients over distributed passes."""

import numpy as np
import pytest
import pyarrow as pa

from descry import FEATURES, ID, TARGET
from descry.operators import linear, solver
from descry.operators.blocks import Matrix

WIDTH, EXTRA = 6000, 1000
TRUE = {7: 2.5, 300: -1.0, 2999: 4.0, 5998: 0.5}  # a sparse solution, and intercept 3


def test_six_thousand_columns_give_the_sparse_solution(spark):
    def rows(batches):
        """Row i < WIDTH is 100 e_i; later rows are random; y = x w + 3 exactly."""
        w = np.zeros(WIDTH)
        for k, v in TRUE.items():
            w[k] = v
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = np.zeros((len(ids), WIDTH))
            for r, i in enumerate(ids):
                if i < WIDTH:
                    x[r, i] = 100.0
                else:
                    x[r] = np.random.default_rng(int(i)).normal(size=WIDTH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(x @ w + 3.0),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * WIDTH, pa.int32()), pa.array(x.ravel()))],
                names=[ID, TARGET, FEATURES])

    df = spark.range(WIDTH + EXTRA, numPartitions=8).mapInArrow(
        rows, f"{ID} long, {TARGET} double, {FEATURES} array<double>").cache()
    m = Matrix(df, tuple(f"c{i}" for i in range(WIDTH)))
    model = linear.fit_gram(m)  # beyond the Gram limit: conjugate gradients
    assert model.converged and model.gap < 1e-9 and model.passes < 100
    coef = np.array(model.coef)
    want = np.zeros(WIDTH)
    for k, v in TRUE.items():
        want[k] = v
    assert np.abs(coef - want).max() < 1e-6
    assert abs(model.intercept - 3.0) < 1e-6


def test_small_fit_equals_gram_path(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12))
    x[:, 4] = 1.5  # a column that does not vary gets 0
    y = x @ rng.normal(size=12) + rng.normal(size=300)
    df = spark.createDataFrame([(i, float(y[i]) if i % 4 else None, x[i].tolist()) for i in range(300)],
                               f"{ID} long, {TARGET} double, {FEATURES} array<double>")
    m = Matrix(df, tuple(f"c{i}" for i in range(12)))
    for alpha in (0.0, 5.0):
        plain, cg = linear.fit_gram(m, alpha=alpha), solver.fit_cg(m, alpha=alpha)
        assert np.allclose(plain.coef, cg.coef, atol=1e-8) and abs(plain.intercept - cg.intercept) < 1e-8
        assert cg.coef[4] == 0.0


def test_a_thousand_splits_cost_at_most_twice_three(spark):
    import time

    from descry.operators import folds
    from descry.operators.blocks import matrix
    from descry.plans.models import LeastSquares

    rng = np.random.default_rng(9)
    n = 3000
    x = rng.normal(size=(n, 6))
    y = x @ rng.normal(size=6) + rng.normal(size=n)
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(n)],
                               "id long, y double, " + ", ".join(f"c{j} double" for j in range(6))).cache()
    names = [f"c{j}" for j in range(6)]
    cost, fitted = {}, {}
    for k in (3, 1000):
        found = folds.stratified_folds(df, 0.0, k, 2).cache()
        m = Matrix(folds.with_folds(matrix(df, names).df, found), tuple(names))
        start = time.time()
        models = LeastSquares(alpha=2.0).fit_folds(m, 2, k)
        preds = linear.predict_folds(m, models, 2, k).collect()
        cost[k] = time.time() - start
        fitted[k] = (found, models, preds)
    assert cost[1000] <= 2 * cost[3] + 2.0, cost
    found, models, preds = fitted[1000]
    fold_of = {(r["id"], r["repeat"]): r["fold"] for r in found.collect()}
    for key in [(0, 0), (1, 517), (1, 999)]:
        rows = [i for i in range(n) if fold_of[i, key[0]] != key[1]]
        z = np.column_stack([np.ones(len(rows)), x[rows]])
        want = np.linalg.solve(z.T @ z + np.diag([0.0] + [2.0] * 6), z.T @ y[rows])
        got = models[key]
        assert [got.intercept, *got.coef] == pytest.approx(want, abs=1e-8)
    assert len(preds) == 2 * n
