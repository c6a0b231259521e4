"""Profiles over one array column: same features as the column recipes, thousands of columns."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from descry import FEATURES, TARGET
from descry.operators import linear, wide
from descry.plans import fixtures as fx
from descry.plans import recipes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    return fx.part_table(spark, SF).cache()


def column_form(raw, name):
    p = recipes.recipe(name).prepare(raw)
    return p.df.select("id", TARGET, *p.names).orderBy("id").toPandas()


@pytest.mark.parametrize("name, prepare", [("non_linear", wide.non_linear), ("ks_filtered", wide.ks_filtered)])
def test_array_profile_equals_column_recipe(raw, name, prepare):
    got = prepare(raw).columns().orderBy("id").toPandas()
    want = column_form(raw, name)
    assert list(got.columns) == list(want.columns)
    assert np.allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-12, atol=1e-12, equal_nan=True)


def test_catalog_tells_what_each_position_is(spark, raw):
    w = wide.non_linear(raw)
    catalog = {r["feature"]: r for r in w.catalog_table(spark).collect()}
    assert catalog["avg_disc_log"]["kind"] == "transform" and catalog["avg_disc_log"]["parents"] == ["avg_disc"]
    assert catalog["avg_disc"]["kind"] == "raw"
    assert any(r["kind"] == "level" and r["parents"] == ["p_size"] for r in catalog.values())
    assert not {"const_one", "holed"} & set(catalog)
    assert w.df.select(F.size(FEATURES)).distinct().collect()[0][0] == len(catalog)


def test_products_and_names(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, None, 4.0, 5.0)], "id long, y double, a double, b double")
    w = wide.from_names(wide.widen(df), ["a*b", "a", "b*a"])
    assert w.names == ["a", "b", "a*b", "b*a"]
    rows = w.columns().orderBy("id").collect()
    assert rows[0]["a*b"] == 6.0 and rows[1]["b*a"] == 20.0
    with pytest.raises(ValueError, match="no such features"):
        wide.products(w, [("a", "c")])


def test_empty_and_odd_values(spark):
    df = spark.createDataFrame([(1, 1.0, float("inf"), 2), (2, 2.0, 1.0, None), (3, None, float("nan"), 2)],
                               "id long, y double, a double, k int")
    w = wide.widen(df)
    assert [f.discrete for f in w.catalog] == [False, True]
    rows = w.df.orderBy("id").collect()
    assert rows[0][FEATURES] == [None, 2.0] and rows[2][FEATURES] == [None, 2.0]
    flags = wide.one_hot(w).columns().orderBy("id").collect()
    assert [r["k_2"] for r in flags] == [1.0, 0.0, 1.0]
    assert wide.figures(wide.keep(w, [])).n.size == 0


def test_distribution_screen_matches_column_form(raw):
    from descry.operators.ks import ks_two_sample

    w = wide.widen(raw, fx.PART_WHOLE)
    got = {r["feature"]: (r["d"], r["p_value"]) for r in wide.ks(w, list(range(len(fx.PART_WHOLE)))).collect()}
    want = {r["feature"]: (r["d"], r["p_value"]) for r in ks_two_sample(raw, fx.PART_WHOLE).collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_two_thousand_columns_prepare_and_fit_in_a_minute(spark):
    rng = np.random.default_rng(5)
    rows, wide_cols = 3600, 1990  # more rows with a target than positions
    x = rng.uniform(-1000, 2000, (rows, wide_cols))  # no gate opens
    frame = pd.DataFrame(x, columns=[f"d{i}" for i in range(wide_cols)])
    for i in range(10):
        frame[f"pos{i}"] = rng.uniform(0.5, 9.0, rows)  # every gate opens
    for i in range(5):
        frame[f"lvl{i}"] = rng.integers(0, 3, rows)
    frame["flat"] = 1.0
    frame["holes"] = np.where(np.arange(rows) % 5 == 0, np.nan, 1.0 + np.arange(rows))
    y = 3 * frame["d0"] - 2 * frame["pos1"] + 0.5 * frame["lvl0"] + rng.normal(0, 0.1, rows)
    frame.insert(0, "y", np.where(np.arange(rows) % 3 == 0, np.nan, y))
    frame.insert(0, "id", np.arange(rows, dtype=np.int64))
    df = spark.createDataFrame(frame).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).cache()
    df.count()
    start = time.time()
    w = wide.non_linear(df)
    model = linear.fit_gram(w.matrix(), alpha=1e-3)
    took = time.time() - start
    assert len(w.names) == wide_cols + 10 + 10 * 9 + 5 * 3
    assert {"flat", "holes"}.isdisjoint(w.names)
    coef = dict(zip(model.names, model.coef))
    assert coef["d0"] > 0.9 and coef["pos1"] < 0, (coef["d0"], coef["pos1"])
    assert took < 60, took
