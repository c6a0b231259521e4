import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from descry.functions.stats import f_critical, f_tail
from descry.operators import cleaning, engineer, profile, scaling
from descry.operators.ks import ks_filter, ks_two_sample
from descry.operators.metrics import roc_auc
from descry.operators.ordered import running_sums


def gap(a, b):
    points = sorted(set(a) | set(b))
    return max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in points)


def sided(spark, test, train):
    rows = [(i, None, float(v)) for i, v in enumerate(test)]
    rows += [(1000 + i, 1.0, float(v)) for i, v in enumerate(train)]
    return spark.createDataFrame(rows, "id long, y double, x double")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=20), st.lists(st.integers(0, 5), min_size=1, max_size=20))
def test_ks_gap_with_ties(spark, test, train):
    row = ks_two_sample(sided(spark, test, train), ["x"]).first()
    assert row["d"] == pytest.approx(gap(test, train), abs=1e-12)
    assert (row["n_test"], row["n_train"]) == (len(test), len(train))
    swapped = ks_two_sample(sided(spark, train, test), ["x"]).first()
    assert swapped["d"] == pytest.approx(row["d"], abs=1e-12)


def test_ks_same_samples_and_empty_side(spark):
    row = ks_two_sample(sided(spark, [1, 2, 3], [1, 2, 3]), ["x"]).first()
    assert (row["d"], row["p_value"]) == (0.0, 1.0)
    row = ks_two_sample(sided(spark, [], [1, 2, 3]), ["x"]).first()
    assert row["d"] is None and row["p_value"] is None
    assert ks_filter(sided(spark, [1.0] * 30, [2.0] * 30), ["x"]).count() == 0


def test_ks_pvalue_series(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=60), rng.normal(0.3, 1, size=80)
    row = ks_two_sample(sided(spark, a, b), ["x"]).first()
    m = 60 * 80 / 140
    lam = (math.sqrt(m) + 0.12 + 0.11 / math.sqrt(m)) * gap(a, b)
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 100))
    assert row["p_value"] == pytest.approx(p, abs=1e-9)


def test_running_sums_in_ranges_equal_plain_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v), int(rng.integers(1, 9))) for g in "ab" for v in rng.exponential(size=900)]
    df = spark.createDataFrame(rows, "g string, v double, c long").groupBy("g", "v").agg(F.sum("c").alias("c"))
    plain = {(r["g"], r["v"]): r["cum_c"] for r in running_sums(df, ["g"], "v", ["c"], 10).collect()}
    cut = {(r["g"], r["v"]): r["cum_c"] for r in running_sums(df, ["g"], "v", ["c"], 900, rows_per_task=20).collect()}
    assert plain == cut and len(plain) == 1800


def test_auc_counts_ties_as_half(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), float(s)) for a, s in zip(rng.integers(0, 2, 200), rng.integers(0, 6, 200))]
    pos, neg = [s for a, s in rows if a], [s for a, s in rows if not a]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "actual int, score double").withColumn("fold", F.lit(0))
    for size in (10**6, 3):
        assert roc_auc(df, ["fold"], "score", size).first()["roc_auc"] == pytest.approx(want)
    assert roc_auc(df.filter("actual = 1"), ["fold"], "score").first()["roc_auc"] is None


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, float(i) if i % 4 else None, 0.1, None, float(i % 3), float(i), i % 2) for i in range(60)]
    return spark.createDataFrame(
        rows, "id long, y double, same double, empty double, few double, many double, bit long")


@pytest.mark.parametrize("block", [2, 100])
def test_column_stats_in_blocks(spark, odd, block, monkeypatch):
    monkeypatch.setattr(profile, "BLOCK", block)
    rows = {r["feature"]: r for r in profile.column_stats(odd, ["same", "empty", "few", "many", "bit"]).collect()}
    assert rows["same"]["sd"] == 0 and rows["empty"]["n_null"] == 60
    assert rows["empty"]["low"] is None and rows["empty"]["sd"] is None
    assert rows["many"]["sd"] == pytest.approx(np.std(np.arange(60), ddof=1))
    assert rows["bit"]["var_pop"] == pytest.approx(0.25)
    assert [r["idx"] for r in rows.values()] is not None


def test_batch_stats_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(profile, "BLOCK", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1, size=(500, 8))
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x],
                               ", ".join(f"{n} double" for n in names)).repartition(7)
    for r in profile._batch_stats(df, names).collect():
        col = x[:, r["idx"]]
        assert r["n"] == np.sum(~np.isnan(col)) and r["n_null"] == np.sum(np.isnan(col))
        assert r["mean"] == pytest.approx(np.nanmean(col), rel=1e-14)
        assert r["var_pop"] == pytest.approx(np.nanvar(col), rel=1e-8)
        assert (r["low"], r["high"]) == (np.nanmin(col), np.nanmax(col))


@pytest.mark.parametrize("parts,batch", [(1, 10000), (5, 3)])
def test_missing_values_mean_the_same_everywhere(spark, parts, batch):
    nan, inf = float("nan"), float("inf")
    rows = [(i, nan if i % 5 == 0 else float(i), inf if i % 7 == 0 else 1.0 + i % 2, None if i % 3 else -inf)
            for i in range(100)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(parts)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        more = df.select("*", *[F.lit(1.0).alias(f"x{i}") for i in range(12)])
        for names in (["a", "b", "c"], ["a", "b", "c", *[f"x{i}" for i in range(12)]]):
            stats = {r["feature"]: r for r in profile.column_stats(more, names).collect()}
            assert (stats["a"]["n"], stats["a"]["n_null"], stats["a"]["low"], stats["a"]["high"]) == (80, 20, 1.0, 99.0)
            assert stats["a"]["mean"] == pytest.approx(np.mean([i for i in range(100) if i % 5]))
            assert stats["b"]["n_null"] == 15 and stats["c"]["n"] == 0 and stats["c"]["sd"] is None
            seen = {r["feature"]: r["n_seen"] for r in profile.distinct_beyond(more, names, 30).collect()}
            assert (seen["a"], seen["b"], seen["c"]) == (31, 2, 0) or seen["a"] > 30
        found = {r["feature"]: r for r in profile.column_profile(df, ["a", "b"]).collect()}
        assert (found["a"]["n_unique"], found["b"]["n_unique"], found["a"]["n_null"]) == (80, 2, 20)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_screens(odd):
    names = ["same", "empty", "few", "many"]
    assert profile.feature_names(profile.zero_variance_screen(odd, names)) == ["few", "many"]
    assert profile.feature_names(profile.low_cardinality_screen(odd, names)) == ["many"]
    assert profile.feature_names(profile.null_column_screen(odd, names)) == ["same", "few", "many"]
    report = {r["stage"]: r["n_removed"] for r in profile.screen_report(odd, names).collect()}
    assert report == {"zero_variance": 2, "low_cardinality": 1, "null_column": 0}
    with pytest.raises(ValueError, match="constant"):
        profile.require_varying_target(odd.withColumn("y", F.lit(1.0)))


def test_select_k_takes_a_scorer(odd):
    top = profile.select_k(odd, ["few", "many"], 1, lambda stats: -F.col("var_pop"))
    assert profile.feature_names(top) == ["few"]


def test_gates_are_strict(spark):
    limits = {"log": 0.0, "exp": 13.0, "exp2": 20.0, "cube": 100.0, "sq": 1000.0}
    for suffix, limit in limits.items():
        low = limit if suffix == "log" else -1.0
        high = 5000.0 if suffix == "log" else limit
        df = spark.createDataFrame([(1, low), (2, high)], "id long, x double")
        assert f"x_{suffix}" not in engineer.nonlinear_expand(df).columns
        step = 1e-9 if suffix == "log" else -1e-9
        shifted = df.withColumn("x", F.when(F.col("x") == limit, limit + step).otherwise(F.col("x")))
        assert f"x_{suffix}" in engineer.nonlinear_expand(shifted).columns


def test_one_hot_refuses_keys(spark, odd):
    assert set(engineer.one_hot_integers(odd, ["bit"]).columns) >= {"bit_0", "bit_1"}
    keys = spark.range(2000).select("id", F.col("id").alias("k"))
    with pytest.raises(ValueError, match="levels"):
        engineer.one_hot_integers(keys, ["k"])


def test_infinite_to_null_and_null_check(spark):
    df = spark.createDataFrame([(1, float("inf")), (2, float("nan")), (3, 1.0)], "id long, x double")
    assert [r["x"] for r in cleaning.drop_infinite(df).orderBy("id").collect()] == [None, None, 1.0]
    with pytest.raises(ValueError, match="x"):
        cleaning.require_no_nulls(cleaning.drop_infinite(df))


def test_column_kinds_by_type(odd):
    assert cleaning.integer_columns(odd) == ["bit"]
    assert cleaning.float_columns(odd) == ["same", "empty", "few", "many"]


def test_scaler_round_trip(spark, odd):
    scaler = scaling.fit_scaler(odd, ["same", "many", "y"])
    assert scaler.sd["same"] == 1.0
    back = odd.select("y", scaler.invert("y", scaler.scale("y")).alias("b")).filter("y is not null")
    assert back.filter(F.abs(F.col("y") - F.col("b")) > 1e-9).count() == 0
    scaled = scaling.standardize(odd, scaler).filter("y is not null").agg(
        F.avg("many"), F.stddev_pop("many")).first()
    assert scaled[0] == pytest.approx(0, abs=1e-12) and scaled[1] == pytest.approx(1)
    assert scaler.table(spark).count() == 3


def test_f_tail_known_values():
    # F(1, dof) is the square of Student's t; with one degree of freedom the tail has a closed form
    f = np.array([0.5, 1.0, 40.0])
    assert f_tail(f, 1) == pytest.approx(1 - 2 / np.pi * np.arctan(np.sqrt(f)), abs=1e-12)
    assert f_tail(np.array([4.964602744]), 10)[0] == pytest.approx(0.05, abs=1e-8)
    assert f_critical(0.05, 10) == pytest.approx(4.964602744, abs=1e-6)
    assert np.isnan(f_tail(np.array([np.nan]), 5)[0])


def test_names_carry_lineage(spark):
    rows = engineer.feature_catalog(spark, ["a", "a_log", "k_3", "a*k_3", "b_c"]).collect()
    assert [(r["kind"], r["parents"], r["op"]) for r in rows] == [
        ("raw", [], None), ("transform", ["a"], "log"), ("level", ["k"], "3"), ("product", ["a", "k_3"], "*"),
        ("raw", [], None)]
    listed = spark.createDataFrame([("b*a",), ("a",), ("a*c",)], "feature string")
    assert engineer.listed_pairs(listed) == [("a", "c"), ("b", "a")]
    assert engineer.parents_of(["b*a", "a", "a*c"]) == [("b", "a"), ("a", "c")]
