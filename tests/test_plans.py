import tempfile

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from descry.operators import linear, runs, trees
from descry.operators.blocks import matrix
from descry.plans import fixtures, models, recipes, validate
from descry.plans.queries import QUERIES
from descry.session import checkpoint_dir
from descry.sources import runlog, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(0)
    n = 180
    a, b, c = rng.normal(5, 1, n), rng.normal(3, 1, n), rng.uniform(0.1, 2, n)
    y = 20 + 4 * a * b + 0.5 * rng.normal(size=n)
    rows = [(i, None if i % 4 == 0 else float(y[i]), float(a[i]), float(b[i]), float(c[i]), i % 3, 7.0,
             float(c[i]) if i % 5 else None, float(a[i]) + (50 if i % 4 == 0 else 0)) for i in range(n)]
    return spark.createDataFrame(
        rows, "id long, y double, a double, b double, c double, kind long, same double, holed double, moved double"
    ).persist()


def prepared(raw, name, features=()):
    return recipes.recipe(name, features).prepare(raw)


def test_simple_recipe(raw):
    p = prepared(raw, "simple")
    assert p.names == ["a", "b", "c", "moved", "kind_0", "kind_1", "kind_2"]
    stats = p.train.agg(*[F.avg(c).alias(c) for c in p.names]).first()
    assert all(abs(v) < 1e-9 for v in stats)
    assert p.df.count() == 180 and p.test.count() == 45


def test_non_linear_recipe(raw):
    names = prepared(raw, "non_linear").names
    assert "c_exp" in names and "a_sq" in names and "kind_0_sq" not in names


def test_interaction_recipe_reads_text(raw):
    text = raw.withColumn("a", F.col("a").cast("string")).withColumn("note", F.lit("none"))
    p = prepared(text, "interactions")
    assert "a*b" in p.names and "note" not in p.names and "holed" in p.names
    assert p.scaler == recipes.Scaler.identity()
    filled = p.df.filter("id = 5").select("holed", "y", "a", "b", F.col("`a*b`").alias("ab")).first()
    assert filled["holed"] == 0.0 and filled["ab"] == pytest.approx(filled["a"] * filled["b"])


def test_screening_recipe(raw):
    p = prepared(raw, "ks_filtered")
    assert "moved" not in p.names and {"a", "b", "c"} <= set(p.names)


def test_listed_recipes(raw):
    assert "a*b" in prepared(raw, "best_list", ["a", "a*b"]).names
    step = prepared(raw, "step_interactions", ["a", "b", "moved"])
    assert all("*" not in n or set(n.split("*")) <= {"a", "b", "moved"} for n in step.names)


def test_reduced_recipe(raw):
    p = prepared(raw, "reduced")
    assert p.names[0] == "pc_1" and "y" in p.scaler.mean and "pc_1" not in p.scaler.mean


def test_unknown_names():
    with pytest.raises(ValueError, match="no recipe"):
        recipes.recipe("other")
    with pytest.raises(ValueError, match="no model"):
        models.model("other")


def test_score_regressor(raw):
    p = prepared(raw, "best_list", ["a*b"])
    got = validate.score_regressor(p, p.names, models.LeastSquares(), 80.0, n_splits=3, repeats=2)
    means = {r["metric"]: r["value"] for r in got.means.collect()}
    assert means["r2_score"] > 0.95 and 0.4 < means["root_mean_sq_error"] < 0.7
    assert got.folds.count() == 6 * 6
    assert got.predictions.count() == 135
    joined = got.predictions.join(raw, "id")
    assert joined.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1.0


def test_any_spark_estimator(raw):
    from pyspark.ml.regression import LinearRegression

    p = prepared(raw, "best_list", ["a*b"])
    ml = LinearRegression(featuresCol=trees.VECTOR, labelCol="y", solver="normal")
    scores = []
    for estimator in (ml, models.LeastSquares()):
        got = validate.score_regressor(p, ["a", "a*b"], estimator, 80.0, n_splits=2, repeats=1)
        scores.append({r["metric"]: r["value"] for r in got.means.collect()})
    assert scores[0] == pytest.approx(scores[1], rel=1e-6)


def test_score_classifier(raw):
    df = raw.filter("y is not null").withColumn("low", (F.col("y") < 75).cast("int"))
    ml = LogisticRegression(featuresCol=trees.VECTOR, labelCol="label")
    got = validate.score_classifier(df, ["a", "b"], "low", ml, n_splits=3, repeats=1)
    assert got.n_splits == 3 and got.folds.count() == 3
    assert got.folds.agg(F.min("roc_auc")).first()[0] > 0.8
    assert got.confusion.agg(F.sum("n")).first()[0] == pytest.approx(45)
    assert got.report.count() == 6


def test_input_checks(raw):
    p = recipes.Prepared(raw.withColumn("y", F.col("y").cast("int")))
    with pytest.raises(TypeError, match="float"):
        validate.score_regressor(p, ["a"], models.LeastSquares(), 1.0, n_splits=2)
    with pytest.raises(TypeError, match="integers"):
        validate.score_classifier(raw, ["a"], "b", None, n_splits=2)


def test_leaderboard(raw):
    specs = [models.model("linear_svr"), models.model("correlation_grouper"), models.model("sgd"),
             models.model("mixed_stepwise", ["a", "b"], ["a", "b"])]
    scores, predictions = validate.leaderboard(raw, specs, 80.0, n_splits=2, repeats=1)
    assert scores.select("model").distinct().count() == 4
    counts = {(r["model"], r["part"]): r["count"] for r in predictions.groupBy("model", "part").count().collect()}
    assert counts == {(s.name, part): n for s in specs for part, n in (("train", 135), ("test", 45))}
    assert predictions.filter("part = 'train' and actual is null").count() == 0
    with pytest.raises(ValueError, match="duplicate"):
        validate.leaderboard(raw.unionByName(raw), specs, 80.0)


def test_array_and_wide_predictions_agree(raw):
    m = matrix(raw, ["a", "b", "c"])
    model = linear.fit_gram(m)
    wide = {r["id"]: r["prediction"] for r in linear.predict(raw, model).collect()}
    for r in m.df.select("id", model.array_column(m.names).alias("p")).collect():
        assert wide[r["id"]] == pytest.approx(r["p"], rel=1e-12)
    assert validate.train_r2(m, model).first()["r2"] > 0.9


# --- sources and runs -------------------------------------------------------------------


def folder():
    return tempfile.mkdtemp(prefix="descry-test-")


def test_csv_round_trip(spark, raw):
    path = folder() + "/t.csv"
    tables.write_table(raw.withColumnRenamed("id", "Name").withColumnRenamed("y", "target"), path, "csv")
    back = tables.read_descriptors(spark, path, "Name", "target")
    assert back.columns == raw.columns and back.schema["kind"].dataType.simpleString() == "int"
    assert back.filter("y is null").count() == 45
    decoys = tables.read_decoys(spark, path, "Name")
    assert decoys.agg(F.min("y"), F.max("y")).first() == (250.0, 250.0)


def test_feature_list(spark):
    path = folder() + "/f.csv"
    tables.write_table(spark.createDataFrame([("a",), ("a*b",)], "features string"), path, "csv")
    assert {r["feature"] for r in tables.read_feature_list(spark, path).collect()} == {"a", "a*b"}


def test_stored_table_is_built_once(spark):
    path, calls = folder() + "/kept", []

    def build():
        calls.append(1)
        return spark.range(5)

    assert tables.stored(spark, build, path).count() == 5
    assert tables.stored(spark, build, path).count() == 5 and len(calls) == 1


def test_run_log(spark):
    path = folder() + "/runs"
    for run, feats in ((0, ["a", "b"]), (1, ["b"])):
        runlog.append_runs(spark.createDataFrame(
            [(run, len(feats), 4.5 + run, f) for f in feats], "run_id int, n_feats int, rmse double, feature string"), path)
    named = runlog.named_runs(spark.read.parquet(path))
    wide = {r["feature"]: r for r in runlog.selected_flags(named).collect()}
    assert wide["a"]["2_feats_4.50_rmse"] == 1 and wide["a"]["1_feats_5.50_rmse"] == 0
    assert runs.check_runs(named.select("run", "n_feats", "rmse")).count() == 3
    with pytest.raises(ValueError, match="do not match"):
        runs.check_runs(named.select("run", (F.col("n_feats") + 1).alias("n_feats"), "rmse"))


def test_merge_run(spark):
    wide = spark.createDataFrame([("a", 1), ("b", 1)], "feature string, r1 int")
    run = spark.createDataFrame([("b", 1), ("c", 1)], "feature string, on int")
    merged = {r["feature"]: (r["r1"], r["r2"]) for r in runlog.merge_run(wide, run, "feature", "r2", "on", 0).collect()}
    assert merged == {"a": (1, 0), "b": (1, 1), "c": (0, 1)}


# Seven saved predictions of two entities, and their 99% intervals.
SAVED = {"first": [39.284330, 6.111903, -6.520357, 9.432484, 24.338378, 19.755626, 12.449363],
         "second": [-15.997296, -3.052442, -2.468827, -7.280882, -0.368374, 23.099754, 7.778449]}
INTERVALS = {"first": (0.762537, 14.978818, 29.195099), "second": (-11.799914, 0.244340, 12.288594)}


def test_saved_intervals(spark):
    wide = spark.createDataFrame([(k, *v) for k, v in SAVED.items()],
                                 "id string, " + ", ".join(f"r{i} double" for i in range(7)))
    got = runs.prediction_intervals(runlog.long_runs(wide)).collect()
    for r in got:
        assert (r["low"], r["mean"], r["high"]) == pytest.approx(INTERVALS[r["id"]], abs=2e-6)
    ranked = [r["id"] for r in runs.rank_entities(runs.prediction_intervals(runlog.long_runs(wide))).collect()]
    assert ranked == ["second", "first"]


def test_importance_counts_unselected_runs_as_zero(spark):
    coefs = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (1, "b", -2.0)], "run_id int, feature string, coef double")
    catalog = spark.createDataFrame([("a",), ("b",), ("c",)], "feature string")
    got = {r["feature"]: r for r in runs.feature_importance(coefs, 4, catalog).collect()}
    values = np.array([1.0, 3.0, 0, 0])
    half = 2.576 * values.std(ddof=1) / 2
    assert got["a"]["selected_percent"] == 0.5 and got["a"]["coef_mean"] == 1.0
    assert got["a"]["max_99_coef"] == pytest.approx(1.0 + half)
    assert got["c"]["selected_percent"] == 0 and got["c"]["max_99_coef"] == 0
    top = runs.top_features(runs.feature_importance(coefs, 4), k=1).collect()
    assert [r["feature"] for r in top] == ["a"]


def test_refitted_coefficients(raw):
    m = matrix(raw, ["a", "b", "c"])
    spark = raw.sparkSession
    listed = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "run_id int, feature string")
    got = {(r["run_id"], r["feature"]): r["coef"] for r in runs.refit_coefficients(m, listed, linear.fit_gram).collect()}
    assert set(got) == {(0, "a"), (0, "b"), (1, "c")} and got[0, "a"] > 5


# --- plans ------------------------------------------------------------------------------


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ks_two_sample", "stratified_folds", "fold_metrics", "cosine_pairs",
                                  "ratio_similarity", "interaction_screen", "run_interval", "join_inner"])
def test_no_cross_product_in_plans(spark, name):
    plan = physical(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_what_they_need(spark):
    spark.catalog.clearCache()
    plan = physical(fixtures.part_table(spark, SF).select("id", "avg_qty"))
    assert "l_quantity" in plan and "l_extendedprice" not in plan and "l_shipdate" not in plan
    plan = physical(fixtures.table(spark, SF, "lineitem").filter("l_quantity > 49").select("l_tax"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan


def test_checkpoint_folder_is_kept(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
