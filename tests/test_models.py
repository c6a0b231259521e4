import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from descry.operators import blocks, folds, linear, metrics, moments, search, trees
from descry.operators.blocks import Matrix, matrix
from descry.operators.linear import Fit, Loss


def frame(spark, x, y, test=()):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(i, None if i in test else float(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))]
    schema = "id long, y double, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema).repartition(4), names


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 6))
    x[:, 5] = x[:, 0] + 0.01 * rng.normal(size=240)
    y = 2 * x[:, 0] - x[:, 2] + 1.5 * x[:, 1] * x[:, 3] + 0.3 * rng.normal(size=240)
    df, names = frame(spark, x, y, test=range(200, 240))
    return x, y, df.persist(), names


def test_correlation_over_blocks_and_rounds(data, monkeypatch):
    x, _, df, names = data
    want = np.corrcoef(x.T)
    for block, fan_in in ((256, 64), (2, 2)):
        monkeypatch.setattr(moments, "BLOCK", block)
        got = moments.correlation_matrix(df, names, fan_in).collect()
        assert len(got) == 15
        for r in got:
            assert r["r"] == pytest.approx(want[r["idx_a"], r["idx_b"]], abs=1e-12)


def test_many_passes_give_the_same_sums(data, monkeypatch):
    x, _, df, names = data
    monkeypatch.setattr(moments, "BLOCK", 2)
    monkeypatch.setattr(moments, "STATE", 64)
    got = {(r["idx_a"], r["idx_b"]): r["r"] for r in moments.correlation_matrix(df, names).collect()}
    want = np.corrcoef(x.T)
    assert all(v == pytest.approx(want[k], abs=1e-12) for k, v in got.items()) and len(got) == 15


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(i, float(i), 0.1) for i in range(9)], "id long, a double, b double")
    assert moments.correlation_matrix(df, ["a", "b"]).first()["r"] is None
    assert moments.column_cosine(df.withColumn("b", F.lit(0.0)), ["a", "b"]).first()["cosine"] is None


def naive_f(columns, target, which):
    z = np.column_stack([np.ones(len(target)), *columns])
    full = target - z @ np.linalg.lstsq(z, target, rcond=None)[0]
    rest = np.delete(z, which + 1, axis=1)
    less = target - rest @ np.linalg.lstsq(rest, target, rcond=None)[0]
    dof = len(target) - z.shape[1]
    return (less @ less - full @ full) / (full @ full / dof)


@pytest.mark.parametrize("mode", ["univariate", "partial"])
@pytest.mark.parametrize("screen_on", ["raw", "scaled"])
def test_pair_screen_equals_naive(data, mode, screen_on):
    x, y, df, names = data
    x, y = x[:200], y[:200]
    base = x if screen_on == "raw" else (x - x.mean(0)) / x.std(0)
    got = moments.interaction_screen(df, names, None, mode, screen_on).collect()
    assert len(got) == 15
    for r in got:
        a, b = base[:, r["idx_a"]], base[:, r["idx_b"]]
        columns, which = ([a * b], 0) if mode == "univariate" else ([a, b, a * b], 2)
        assert r["f_stat"] == pytest.approx(naive_f(columns, y, which), rel=1e-6)
    best = max(got, key=lambda r: r["f_stat"])
    assert (best["feature_a"], best["feature_b"]) == ("x1", "x3")
    kept = moments.interaction_screen(df, names, 0.01, mode, screen_on).collect()
    assert {(r["idx_a"], r["idx_b"]) for r in kept} == {
        (r["idx_a"], r["idx_b"]) for r in got if r["p_value"] < 0.01}


def test_least_squares_ridge_lasso(data):
    x, y, df, names = data
    m = matrix(df, names)
    z = np.column_stack([np.ones(200), x[:200]])
    model = linear.fit_gram(m)
    want = np.linalg.lstsq(z, y[:200], rcond=None)[0]
    assert [model.intercept, *model.coef] == pytest.approx(want, abs=1e-8)
    penal = np.diag([0.0] + [5.0] * 6)
    want = np.linalg.solve(z.T @ z + penal, z.T @ y[:200])
    model = linear.fit_gram(m, alpha=5.0)
    assert [model.intercept, *model.coef] == pytest.approx(want, abs=1e-8)
    model = linear.fit_gram(m, l1=0.1)
    w = np.array(model.coef)
    grad = x[:200].T @ (y[:200] - x[:200] @ w - model.intercept) / 200
    assert np.all(np.abs(grad) <= 0.1 + 1e-6) and (w == 0).any()
    assert grad[w != 0] == pytest.approx(0.1 * np.sign(w[w != 0]), abs=1e-6)


def test_least_squares_agrees_with_the_built_in(data):
    _, _, df, names = data
    m = matrix(df, names[:5])
    built_in = LinearRegression(featuresCol=trees.VECTOR, labelCol="y", solver="normal").fit(
        trees.with_vector(linear.train_matrix(m)))
    assert list(linear.fit_gram(m).coef) == pytest.approx(list(built_in.coefficients), abs=1e-6)


@pytest.mark.parametrize("c,eps", [(1.0, 0.0), (0.05, 0.0), (1.0, 0.2)])
def test_absolute_svr_is_certified(data, c, eps):
    x, y, df, names = data
    model = linear.linear_svr(matrix(df, names), c, eps)
    assert 0 <= model.gap <= 1e-3
    z = np.column_stack([np.ones(200), x[:200]])

    def objective(w):
        return 0.5 * w @ w + c * np.maximum(np.abs(y[:200] - z @ w) - eps, 0).sum()

    w = np.array([model.intercept, *model.coef])
    rng = np.random.default_rng(1)
    best = min(objective(w + s * rng.normal(size=7)) for s in (1e-4, 1e-3, 1e-2, 0.1) for _ in range(300))
    assert objective(w) <= best * (1 + 1e-3)


def test_squared_svr(data):
    x, y, df, names = data
    z = np.column_stack([np.ones(200), x[:200]])
    model = linear.linear_svr_squared(matrix(df, names))
    want = np.linalg.solve(np.eye(7) + 2 * z.T @ z, 2 * z.T @ y[:200])
    assert [model.intercept, *model.coef] == pytest.approx(want, abs=1e-6)
    model = linear.linear_svr_squared(matrix(df, names), eps=0.3)
    w = np.array([model.intercept, *model.coef])
    r = y[:200] - z @ w
    grad = w - 2 * z.T @ (np.sign(r) * np.maximum(np.abs(r) - 0.3, 0))
    assert np.abs(grad).max() < 0.05


def test_huber_l1_is_stationary(data):
    x, y, df, names = data
    model = linear.huber_l1(matrix(df, names), alpha=0.02)
    w = np.array(model.coef)
    r = y[:200] - x[:200] @ w - model.intercept
    grad = x[:200].T @ np.clip(r, -0.1, 0.1) / 200
    assert np.all(np.abs(grad) <= 0.02 + 2e-3)
    assert np.clip(r, -0.1, 0.1).mean() == pytest.approx(0, abs=2e-3)
    assert all(v == 0 for v in linear.huber_l1(matrix(df, names), alpha=5.0).coef)


def held(df, names, repeats=2, k=3):
    found = folds.stratified_folds(df, 0.0, k, repeats)
    return found, Matrix(folds.with_folds(matrix(df, names).df, found), tuple(names))


def test_folds_fitted_together_equal_separate_fits(data, monkeypatch):
    x, y, df, names = data
    found, m = held(df, names)
    keys = [(r, f) for r in range(2) for f in range(3)]
    fits = [Fit(tuple(range(6)), k) for k in keys]
    monkeypatch.setattr(linear, "STATE", 1500)  # several models per pass, several passes
    models = linear.fit_reweighted(m, fits, Loss("squared"))
    fold_of = {(r["id"], r["repeat"]): r["fold"] for r in found.collect()}
    for (r, f), model in zip(keys, models):
        rows = [i for i in range(200) if fold_of[i, r] != f]
        z = np.column_stack([np.ones(len(rows)), x[rows]])
        want = np.linalg.solve(np.eye(7) + 2 * z.T @ z, 2 * z.T @ y[rows])
        assert [model.intercept, *model.coef] == pytest.approx(want, abs=1e-6)


def test_held_out_predictions_and_fold_errors(data):
    x, y, df, names = data
    found, m = held(df, names)
    grams = linear.collect_grams(linear.train_matrix(m), 2, 3)
    solved = linear.fold_solutions(grams, range(6))
    models = {k: linear.LinearModel(m.names, tuple(w), b) for k, (w, b) in solved.items()}
    preds = linear.predict_folds(m, models, 2, 3).collect()
    assert len(preds) == 400
    for key, (w, b) in solved.items():
        mine = [p for p in preds if (p["repeat"], p["fold"]) == key]
        sse = sum((p["actual"] - p["prediction"]) ** 2 for p in mine)
        assert linear.fold_error(grams[key], range(6), w, b) == pytest.approx(sse, rel=1e-8)
        for p in mine[:5]:
            assert p["prediction"] == pytest.approx(x[p["id"]] @ w + b)


def test_best_ridge(data):
    x, y, df, names = data
    _, m = held(df, names)
    model, alpha = linear.best_ridge(m, 2, 3, (1.0, 1e6))
    assert alpha == 1.0 and model.coef == linear.fit_gram(m, 1.0).coef


def test_folds_are_balanced_and_repeatable(data):
    _, _, df, _ = data
    base = {tuple(r) for r in folds.stratified_folds(df, 0.0, 4, 3, prefix=1).collect()}
    assert base == {tuple(r) for r in folds.stratified_folds(df.repartition(2), 0.0, 4, 3, prefix=3).collect()}
    assert len(base) == 600
    label = {r["id"]: r["y"] < 0 for r in df.filter("y is not null").select("id", "y").collect()}
    for repeat in range(3):
        for cls in (True, False):
            sizes = [sum(1 for i, r, f in base if (r, f) == (repeat, k) and label[i] == cls) for k in range(4)]
            assert max(sizes) - min(sizes) <= 1
    assert base != {tuple(r) for r in folds.stratified_folds(df, 0.0, 4, 3, seed=5).collect()}


def test_fold_counts(data):
    _, _, df, _ = data
    assert folds.choose_splits(df, 0.0, None, cap=7) == 7
    least = df.agg(F.min("y")).first()[0]
    with pytest.raises(ValueError, match="two splits"):
        folds.choose_splits(df, least + 1e-9, None)
    with pytest.raises(ValueError, match="duplicate"):
        folds.require_unique_ids(df.unionByName(df.limit(1)))


def test_exact_median_by_brackets(spark, monkeypatch):
    monkeypatch.setattr(metrics, "MEDIAN_ACCURACY", 50)
    rng = np.random.default_rng(4)
    for n in (51, 400, 401):
        values = np.abs(np.round(rng.normal(size=n), 2))
        df = spark.createDataFrame([(0, float(v)) for v in values], "g int, e double")
        assert metrics.exact_median(df, ["g"], "e").first()["median"] == pytest.approx(np.median(values), abs=1e-12)


def test_constant_fold_has_no_r2(spark):
    df = spark.createDataFrame([("m", 0, 0, 1.0, 2.0), ("m", 0, 0, 1.0, 0.0)],
                               "model string, repeat int, fold int, actual double, prediction double")
    got = {r["metric"]: r["value"] for r in metrics.fold_metrics(df).collect()}
    assert got["r2_score"] is None and got["mean_sq_error"] == 1.0


def test_group_rule():
    names = ["a", "b", "c", "d", "e"]
    groups = search.correlation_groups(names, [("a", "c"), ("b", "c"), ("b", "e")])
    # c joins both groups, leaders come last, d stands alone
    assert groups == [["c", "a"], ["c", "e", "b"], ["d"]]


def test_representatives(spark):
    groups = search.groups_table(spark, [["c", "a"], ["d"]])
    first = {r["feature"] for r in search.representatives(groups).collect()}
    lead = {r["feature"] for r in search.representatives(groups, "leader").collect()}
    assert (first, lead) == ({"c", "d"}, {"a", "d"})


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 9))
    y = 3 * x[:, 1] - 2 * x[:, 4] + x[:, 7] + 0.1 * rng.normal(size=150)
    df, names = frame(spark, x, y)
    _, m = held(df, names)
    return Matrix(m.df.persist(), m.names), names


def test_search_finds_the_planted_columns(planted):
    m, names = planted
    scorer = search.RidgeScorer(m, 2, 3)
    groups = [[n] for n in names]
    found = search.mixed_stepwise(scorer, groups, 12, {"x0", "x1"}, seed=1)
    assert {"x1", "x4", "x7"} <= set(found.features)
    scores = [h[3] for h in found.history]
    assert all(b <= a for a, b in zip(scores, scores[1:]))
    again = search.mixed_stepwise(scorer, groups, 12, {"x0", "x1"}, seed=1)
    assert again == found


def test_svr_scorer_agrees_on_the_best(planted):
    m, names = planted
    sets = {n: ["x1", n] for n in ("x0", "x4", "x7")}
    ridge = search.best_candidate(search.RidgeScorer(m, 2, 3).scores(sets)).first()["feature"]
    svr = search.best_candidate(search.SvrScorer(m, 2, 3).scores(sets)).first()["feature"]
    assert ridge == svr == "x4"


def test_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "feature string, score double")
    assert search.best_candidate(df).first()["feature"] == "a"


def test_start_sets():
    groups = [["a", "b"], ["c"], ["d", "e"]]
    start = search.init_features(groups, 2, seed=3)
    assert len(start) == 2 and start == search.init_features(groups, 2, seed=3)
    assert len(search.init_features(groups, 9, seed=3)) == 3


class Flat:
    """Scores that never improve."""

    def __init__(self, spark):
        self.spark, self.calls = spark, 0

    def scores(self, sets):
        self.calls += 1
        return self.spark.createDataFrame([(k, 1.0 + len(v) % 2) for k, v in sets.items()], "feature string, score double")


def test_search_stops_and_grows_batches(spark):
    flat = Flat(spark)
    groups = [[f"f{i}"] for i in range(40)]
    found = search.mixed_stepwise(flat, groups, 500, {"f0", "f1"}, batch=2, growth=3)
    assert found.features == ["f0", "f1"] and flat.calls < 25


def test_ensembles_beat_the_mean(data):
    x, y, df, names = data
    m = matrix(df, names)
    base = np.var(y[:200])
    fitted = [trees.random_forest(m), trees.gradient_boosting(m), trees.adaboost(m, rounds=5)]
    for model in fitted:
        out = trees.predict_ml(m, model).filter("y is not null")
        assert out.agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0] < 0.7 * base


def test_fourier_features_approach_the_kernel(data):
    x, _, df, names = data
    rows = trees.fourier_features(matrix(df, names), 3000, gamma=0.1).df.select("id", "features").collect()
    z = {r["id"]: np.array(r["features"]) for r in rows}
    for i, j in ((0, 1), (2, 9), (5, 6)):
        assert z[i] @ z[j] == pytest.approx(np.exp(-0.1 * np.sum((x[i] - x[j]) ** 2)), abs=0.08)


def test_pca_up_to_sign(data):
    x, _, df, names = data
    s = (x - x.mean(0)) / x.std(0)
    want = np.linalg.svd(s, full_matrices=False)
    got = trees.pca(df, names, 100)
    assert len(got.names) == 6
    rows = sorted(got.df.collect(), key=lambda r: r["id"])
    scores = np.array([r["features"] for r in rows])
    assert np.abs(scores[:, 0]) == pytest.approx(np.abs(s @ want[2][0]), abs=1e-6)


def test_reduction_with_many_partials(spark):
    rows = [(i % 2, [float(i), 1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, sums array<double>").repartition(20)
    got = {r["k"]: r["sums"] for r in blocks.add_up(df, ["k"], 1000, fan_in=4).collect()}
    assert got == {0: [2450.0, 50.0], 1: [2500.0, 50.0]}
    assert {k[0]: list(v) for k, v in blocks.gather_sums(df, ["k"], 20, 4).items()} == got


def test_fits_refuse_missing_features_by_name(spark):
    rows = [(i, float(i), float(i % 7), None if i == 5 else float(i % 3)) for i in range(40)]
    m = matrix(spark.createDataFrame(rows, "id long, y double, a double, holed double"), ["a", "holed"])
    for fit in (linear.fit_gram, linear.linear_svr, linear.huber_l1):
        with pytest.raises(ValueError, match="holed"):
            fit(m)


def test_a_stopped_fit_says_so(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal()), *map(float, rng.normal(size=3))) for i in range(60)]
    m = matrix(spark.createDataFrame(rows, "id long, y double, a double, b double, c double"), ["a", "b", "c"])
    fit = [linear.Fit((0, 1, 2))]
    with pytest.warns(RuntimeWarning, match="stopped after 2 passes"):
        stopped = linear.fit_reweighted(m, fit, linear.Loss("absolute"), max_passes=2)[0]
    assert not stopped.converged and linear.linear_svr(m).converged
