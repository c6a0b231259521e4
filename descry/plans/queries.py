"""Registered queries over the given tables, and the same results in plain SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry import ID, TARGET
from descry.functions.columns import (GATES, finite, label_below, product_name, run_rmse,
                                      run_size)
from descry.operators import cleaning as clean
from descry.operators import engineer, folds, ks, linear, metrics, moments, profile
from descry.operators import runs as run_ops
from descry.operators import scaling, search, similarity, spanning, trees, wide
from descry.operators.blocks import Matrix, matrix
from descry.plans import fixtures as fx
from descry.plans import models, recipes, validate
from descry.sources import runlog
from descry.sources.tables import as_descriptors, with_constant_target

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MIN_COSINE = 0.3
MIN_RATIO = 0.9999
MIN_R2 = 0.03
LISTED = ["avg_qty", "avg_qty*avg_disc", "avg_disc*max_disc"]
PAIRS = [("avg_qty", "avg_disc"), ("avg_price", "avg_tax")]
FLOATS = ["p_retailprice", "avg_qty", "avg_price", "avg_disc", "avg_tax", "max_disc"]
SEARCHED = ["p_retailprice", "avg_qty", "avg_price", "avg_disc", "avg_tax", "max_disc", "twin"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function name, with its SQL when there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6, only: Sequence[str] | None = None) -> DataFrame:
    """Rounds doubles that two engines may add up in different orders."""
    names = [n for n, t in df.dtypes if t == "double" and (only is None or n in only)]
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in names else F.col(f"`{c}`")
                       for c in df.columns])


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """The part table for operators that read it several times: built once, spilled to disk
    where memory is short."""
    return fx.part_table(spark, sf).persist()


def _kept(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(ID, TARGET, *names)


def _long_sql(names: Sequence[str], source: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}'{c}' AS feature, {c}::DOUBLE AS value FROM {source}" for c in names)


LONG_PART = _long_sql(fx.PART_NUMERIC, "parts", "y IS NULL AS is_test, ")

# --- sources, projection, filters -------------------------------------------------------


@query(f"""
SELECT feature, count(value) AS n, count(*) - count(value) AS n_null, min(value) AS low,
       max(value) AS high, round(stddev_samp(value), 6) AS sd, count(DISTINCT value) AS n_unique
FROM ({_long_sql(fx.LINE_NUMERIC, "lineitem")}) GROUP BY feature""")
def column_profile(spark, sf):
    return rounded(profile.column_profile(fx.table(spark, sf, "lineitem"), fx.LINE_NUMERIC), only=["sd"])


@query(f"""WITH {fx.PART_SQL}, long AS ({LONG_PART})
SELECT feature, round(stddev_samp(value), 6) AS sd FROM long GROUP BY feature
HAVING stddev_samp(value) > 0""")
def zero_variance_screen(spark, sf):
    out = profile.zero_variance_screen(_parts(spark, sf), fx.PART_NUMERIC)
    return rounded(out.select("feature", "sd"))


@query(f"""WITH {fx.PART_SQL}, long AS ({LONG_PART})
SELECT feature FROM long GROUP BY feature HAVING count(DISTINCT value) > 3""")
def low_cardinality_screen(spark, sf):
    return profile.low_cardinality_screen(_parts(spark, sf), fx.PART_NUMERIC).select("feature")


@query(f"""WITH {fx.PART_SQL}, long AS ({LONG_PART})
SELECT feature FROM long GROUP BY feature HAVING count(*) = count(value)""")
def null_column_screen(spark, sf):
    return profile.null_column_screen(_parts(spark, sf), fx.PART_NUMERIC).select("feature")


@query(f"""WITH {fx.PART_SQL}, long AS ({LONG_PART}),
f AS (SELECT feature, stddev_samp(value) > 0 AS v, count(DISTINCT value) > 3 AS m,
             count(*) = count(value) AS w FROM long GROUP BY feature),
c AS (SELECT count(*) AS n0, count(*) FILTER (v) AS n1, count(*) FILTER (v AND m) AS n2,
             count(*) FILTER (v AND m AND w) AS n3 FROM f)
SELECT 1 AS step, 'zero_variance' AS stage, n0 AS n_before, n1 AS n_after, n0 - n1 AS n_removed FROM c
UNION ALL SELECT 2, 'low_cardinality', n1, n2, n1 - n2 FROM c
UNION ALL SELECT 3, 'null_column', n2, n3, n2 - n3 FROM c""")
def screen_report(spark, sf):
    return profile.screen_report(_parts(spark, sf), fx.PART_NUMERIC)


@query(f"""WITH {fx.PART_SQL}
SELECT id, y, p_size, p_retailprice, avg_qty, holed, drift FROM parts
WHERE y IS NOT NULL AND holed IS NOT NULL""")
def complete_rows(spark, sf):
    return clean.complete_rows(clean.pick(
        fx.part_table(spark, sf), ["p_size", "p_retailprice", "avg_qty", "holed", "drift"]))


@query(f"""WITH {fx.PART_SQL}
SELECT id, y, avg_qty, CASE WHEN y IS NULL THEN 'test' ELSE 'train' END AS part FROM parts""")
def target_split(spark, sf):
    df = clean.pick(fx.part_table(spark, sf), ["avg_qty"])
    return clean.train_rows(df).withColumn("part", F.lit("train")).unionByName(
        clean.test_rows(df).withColumn("part", F.lit("test")))


@query(f"""WITH {fx.PART_SQL}
SELECT id, y, p_size, p_retailprice FROM parts ORDER BY id LIMIT 10""")
def preview(spark, sf):
    return clean.preview(fx.part_table(spark, sf), 4, 10)


@query(f"""WITH {fx.PART_SQL}
SELECT id, y, avg_qty, avg_price, avg_disc, avg_tax FROM parts""")
def select_features(spark, sf):
    df = _parts(spark, sf)
    catalog = profile.null_column_screen(df, fx.PART_NUMERIC)
    listed = spark.createDataFrame([(c,) for c in fx.PART_NUMERIC if c.startswith("avg")], "feature string")
    return clean.pick(df, profile.feature_names(clean.keep_listed(catalog, listed)))


@query("""
SELECT event_id AS id, coalesce(TRY_CAST(event_type AS DOUBLE), 0) AS event_type,
       coalesce(TRY_CAST(props AS DOUBLE), 0) AS props,
       coalesce(TRY_CAST(value::VARCHAR AS DOUBLE), 0) AS value FROM events""")
def coerce_numeric(spark, sf):
    events = fx.table(spark, sf, "events").select(
        F.col("event_id").alias(ID), "event_type", "props", F.col("value").cast("string").alias("value"))
    return clean.fill_missing(clean.coerce_numeric(events))


@query(f"""WITH {fx.PART_SQL}
SELECT id, CASE WHEN p_size > 3 THEN avg_qty END AS value FROM parts""")
def clean_infinite(spark, sf):
    df = fx.part_table(spark, sf).select(
        ID, F.when(F.col("p_size") == 1, float("inf")).when(F.col("p_size") == 2, float("-inf"))
        .when(F.col("p_size") == 3, float("nan")).otherwise(F.col("avg_qty")).alias("value"))
    return df.select(ID, finite(F.col("value")).alias("value"))


@query("SELECT p_partkey AS id, 250.0::DOUBLE AS y, p_size, p_retailprice FROM part")
def decoy_rows(spark, sf):
    parts = fx.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return with_constant_target(as_descriptors(parts, "p_partkey"))


# --- screens ----------------------------------------------------------------------------

KS_SQL = f"""{fx.PART_SQL}, long AS ({LONG_PART}),
vals AS (
  SELECT feature, value, count(*) FILTER (is_test) AS a, count(*) FILTER (NOT is_test) AS b
  FROM long WHERE value IS NOT NULL GROUP BY feature, value),
cum AS (
  SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER t AS na, sum(b) OVER t AS nb
  FROM vals WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING),
                   t AS (PARTITION BY feature)),
gap AS (
  SELECT feature, max(na)::BIGINT AS n_test, max(nb)::BIGINT AS n_train, count(*) AS n_unique,
         max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)) AS d
  FROM cum GROUP BY feature),
ks AS (
  SELECT *, (sqrt(n_test::DOUBLE * n_train / (n_test + n_train)) + 0.12
             + 0.11 / sqrt(n_test::DOUBLE * n_train / (n_test + n_train))) * d AS lam FROM gap),
ksp AS (
  SELECT feature, n_test, n_train, n_unique, d,
         CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0,
           list_sum(list_transform(range(1, 21), lambda k:
             (CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END)
             * exp(-2.0::DOUBLE * k * k * lam * lam))))) END AS p_value
  FROM ks)"""


@query(f"""WITH {KS_SQL}
SELECT feature, n_test, n_train, n_unique, round(d, 6) AS d, round(p_value, 6) AS p_value FROM ksp""")
def ks_two_sample(spark, sf):
    return rounded(ks.ks_two_sample(_parts(spark, sf), fx.PART_NUMERIC))


@query(f"""WITH {KS_SQL}
SELECT feature, round(d, 6) AS d, round(p_value, 6) AS p_value FROM ksp WHERE p_value > 0.1""")
def ks_filter(spark, sf):
    return rounded(ks.ks_filter(_parts(spark, sf), fx.PART_NUMERIC).select("feature", "d", "p_value"))


@query(f"""WITH {KS_SQL},
stats AS (SELECT feature, stddev_samp(value) AS sd FROM long GROUP BY feature
          HAVING count(*) = count(value) AND count(DISTINCT value) > 3 AND stddev_samp(value) > 0)
SELECT feature, round(sd, 6) AS sd, n_unique, round(d, 6) AS d, round(p_value, 6) AS p_value
FROM ksp JOIN stats USING (feature) WHERE p_value > 0.1""")
def screened_profile(spark, sf):
    return rounded(ks.screened_profile(_parts(spark, sf), fx.PART_NUMERIC))


F_SQL = "round(power(r, 2) / (1 - power(r, 2)) * (n - 2), 3) AS f_stat"


@query(f"""WITH {fx.PART_SQL}, long AS ({_long_sql(fx.PART_WHOLE, "parts", "y, ")})
SELECT feature, n, round(r, 6) AS r, {F_SQL} FROM (
  SELECT feature, count(y) AS n, corr(value, y) AS r FROM long WHERE y IS NOT NULL GROUP BY feature)""")
def univariate_f(spark, sf):
    out = moments.univariate_f(fx.part_table(spark, sf), fx.PART_WHOLE)
    return out.select("feature", "n", F.round("r", 6).alias("r"), F.round("f_stat", 3).alias("f_stat"))


@query(f"""WITH {fx.PART_SQL}, long AS ({_long_sql(fx.PART_WHOLE, "parts")})
SELECT feature, round(var_pop(value), 2) AS var_pop FROM long GROUP BY feature
ORDER BY var_pop(value) DESC LIMIT 5""")
def select_k_by_variance(spark, sf):
    out = profile.select_k(fx.part_table(spark, sf), fx.PART_WHOLE, 5)
    return rounded(out.select("feature", "var_pop"), 2)


# --- engineering ------------------------------------------------------------------------


@query(f"""WITH {fx.PART_SQL},
hot AS (SELECT 'p_size_' || p_size AS feature FROM parts
        UNION ALL SELECT 'n_lines_' || n_lines FROM parts)
SELECT feature, (SELECT count(*) FROM parts) AS n_rows, count(*) AS n_ones FROM hot GROUP BY feature""")
def one_hot_integers(spark, sf):
    hot = engineer.one_hot_integers(_parts(spark, sf).select(ID, "p_size", "n_lines"), ["p_size", "n_lines"])
    names = [c for c in hot.columns if c != ID]
    sums = hot.agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(c) for c in names])
    return sums.unpivot(["n_rows"], names, "feature", "n_ones")


@query("""
SELECT o_orderkey AS id, 'o_custkey_' || o_custkey AS feature FROM orders WHERE o_custkey IS NOT NULL""")
def one_hot_long(spark, sf):
    orders = fx.table(spark, sf, "orders").withColumnRenamed("o_orderkey", ID)
    return engineer.one_hot_long(orders, ["o_custkey"])


SQL_TRANSFORMS = {
    "log": "round(ln({c}), 6)", "log2": "round(log2({c}), 6)", "log10": "round(log10({c}), 6)",
    "cubert": "round(cbrt({c}), 6)", "sqrt": "sqrt({c})", "exp": "round(exp({c}), 6)",
    "exp2": "round(power(2.0::DOUBLE, {c}), 6)", "cube": "{c} * {c} * {c}", "sq": "{c} * {c}"}
LOGS = ["log", "log2", "log10", "cubert", "sqrt"]
OPEN_GATES = {"p_retailprice": [*LOGS, "sq"], "avg_qty": [*LOGS, "cube", "sq"], "avg_price": LOGS,
              "avg_disc": list(GATES), "avg_tax": list(GATES), "max_disc": list(GATES)}
EXPANDED = ", ".join(f'{SQL_TRANSFORMS[s].format(c=c)} AS "{c}_{s}"' for c, ss in OPEN_GATES.items() for s in ss)
INEXACT = [f"{c}_{s}" for c, ss in OPEN_GATES.items() for s in ss
           if s in ("log", "log2", "log10", "cubert", "exp", "exp2")]


@query(f"WITH {fx.PART_SQL} SELECT id, {EXPANDED} FROM parts")
def nonlinear_expand(spark, sf):
    out = engineer.nonlinear_expand(_parts(spark, sf).select(ID, *FLOATS))
    return rounded(out.drop(*FLOATS), only=INEXACT)


@query(f"""WITH {fx.PART_SQL}
SELECT id, avg_qty * avg_disc AS "avg_qty*avg_disc", avg_price * avg_tax AS "avg_price*avg_tax" FROM parts""")
def interaction_values(spark, sf):
    df = fx.part_table(spark, sf).select(ID, *FLOATS)
    return engineer.interaction_values(df, PAIRS).drop(*FLOATS)


@query(f"""WITH {fx.PART_SQL}
SELECT id, avg_qty * avg_disc AS "avg_qty*avg_disc", avg_disc * max_disc AS "avg_disc*max_disc" FROM parts""")
def interaction_from_names(spark, sf):
    df = fx.part_table(spark, sf).select(ID, *FLOATS)
    listed = spark.createDataFrame([(n,) for n in LISTED], "feature string")
    return engineer.interaction_values(df, engineer.listed_pairs(listed)).drop(*FLOATS)


@query(f"""WITH {fx.PART_SQL}
SELECT id, avg_qty, avg_disc, round(ln(avg_qty), 6) AS avg_qty_log, avg_disc * avg_disc AS avg_disc_sq,
       avg_qty * avg_disc AS "avg_qty*avg_disc" FROM parts""")
def combine_features(spark, sf):
    df = fx.part_table(spark, sf).select(ID, "avg_qty", "avg_disc")
    out = engineer.combine_features(df, [("avg_qty", "log"), ("avg_disc", "sq")], PAIRS[:1])
    return rounded(out, only=["avg_qty_log"])


def _pair_sql(source: str, names: Sequence[str], where: str = "y IS NOT NULL") -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(y) AS n, corr({a} * {b}, y) AS r "
        f"FROM {source} WHERE {where}"
        for i, a in enumerate(names) for b in names[i + 1:])


@query(f"""WITH {fx.PART_SQL}
SELECT feature_a || '*' || feature_b AS feature, round(r, 6) AS r, {F_SQL}
FROM ({_pair_sql("parts", fx.PART_MODEL)})""")
def interaction_screen(spark, sf):
    out = moments.interaction_screen(_parts(spark, sf), fx.PART_MODEL, alpha=None)
    return out.select(product_name("feature_a", "feature_b").alias("feature"), F.round("r", 6).alias("r"),
                      F.round("f_stat", 3).alias("f_stat"))


SCALED = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in fx.PART_MODEL)


@query(f"""WITH {fx.PART_SQL}, scaled AS (SELECT y, {SCALED} FROM parts WHERE y IS NOT NULL)
SELECT feature_a, feature_b, round(r, 6) AS r, {F_SQL} FROM ({_pair_sql("scaled", fx.PART_MODEL)})""")
def interaction_scaled_screen(spark, sf):
    out = moments.interaction_screen(_parts(spark, sf), fx.PART_MODEL, alpha=None, screen_on="scaled")
    return out.select("feature_a", "feature_b", F.round("r", 6).alias("r"), F.round("f_stat", 3).alias("f_stat"))


@query(f"""WITH {fx.PART_SQL},
s AS (SELECT avg(avg_qty) AS mq, stddev_pop(avg_qty) AS sq, avg(avg_price) AS mp, stddev_pop(avg_price) AS sp,
             avg(avg_disc) AS md, stddev_pop(avg_disc) AS sd FROM parts WHERE y IS NOT NULL)
SELECT id, round((avg_qty - mq) / sq, 6) AS avg_qty, round((avg_price - mp) / sp, 6) AS avg_price,
       round((avg_disc - md) / sd, 6) AS avg_disc FROM parts, s""")
def standardize(spark, sf):
    names = ["avg_qty", "avg_price", "avg_disc"]
    df = _kept(_parts(spark, sf), names)
    return rounded(scaling.standardize(df, scaling.fit_scaler(df, names)).select(ID, *names))


@query(f"""WITH {fx.PART_SQL},
s AS (SELECT avg(y) AS m, stddev_pop(y) AS sd FROM parts WHERE y IS NOT NULL)
SELECT id, round((y - m) / sd, 6) AS scaled, round(y, 6) AS back, (y < 100.0)::INT AS below
FROM parts, s""")
def target_scale(spark, sf):
    df = _kept(_parts(spark, sf), [])
    scaler = scaling.fit_scaler(df, [TARGET])
    scaled = scaler.scale(TARGET)
    return rounded(df.select(ID, scaled.alias("scaled"), scaler.invert(TARGET, scaled).alias("back"),
                             label_below(scaled, scaler.cut(100.0)).alias("below")))


@query(f"WITH {fx.PART_SQL} SELECT id, y, avg_qty FROM parts")
def identity_scale(spark, sf):
    return scaling.standardize(_kept(fx.part_table(spark, sf), ["avg_qty"]), scaling.Scaler.identity())


@query(f"WITH {fx.PART_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{s}' AS transform, round(corr({c}, {e.format(c=c)}), 6) AS r FROM parts"
    for c in FLOATS for s, e in {"log": "ln({c})", "sqrt": "sqrt({c})", "cube": "{c} * {c} * {c}",
                                 "sq": "{c} * {c}"}.items()))
def transform_correlation(spark, sf):
    return rounded(engineer.transform_correlation(fx.part_table(spark, sf), FLOATS))


# --- joins ------------------------------------------------------------------------------


@query(f"WITH {fx.PART_SQL} SELECT id, y, avg_qty, p_brand FROM parts JOIN part ON id = p_partkey")
def join_inner(spark, sf):
    brands = fx.table(spark, sf, "part").select(F.col("p_partkey").alias(ID), "p_brand")
    return clean.join_inner(_kept(fx.part_table(spark, sf), ["avg_qty"]), brands)


@query("""
SELECT coalesce(a.id, b.id) AS id, a.n_open, b.n_done FROM
  (SELECT o_custkey AS id, count(*) AS n_open FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) a
  FULL JOIN (SELECT o_custkey AS id, count(*) AS n_done FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b
  ON a.id = b.id""")
def join_full(spark, sf):
    orders = fx.table(spark, sf, "orders")
    done = F.col("o_orderstatus") == "F"
    by = [orders.filter(kept).groupBy(F.col("o_custkey").alias(ID)).agg(F.count(F.lit(1)).alias(n))
          for kept, n in ((~done, "n_open"), (done, "n_done"))]
    return clean.join_full(*by)


@query("""
SELECT c_custkey AS id, c_acctbal, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def join_left_zero(spark, sf):
    customers = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias(ID), "c_acctbal")
    orders = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias(ID)).agg(
        F.count(F.lit(1)).alias("n_orders"))
    return clean.join_left_zero(customers, orders)


@query("""
SELECT l_partkey AS id, max(l_quantity) AS most, min(l_quantity) AS least, count(*) AS n
FROM lineitem GROUP BY l_partkey""")
def concat_columns(spark, sf):
    # columns keyed alike come from one aggregate: nothing is joined
    return fx.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias(ID)).agg(
        F.max("l_quantity").alias("most"), F.min("l_quantity").alias("least"), F.count(F.lit(1)).alias("n"))


# --- moments ----------------------------------------------------------------------------


def _corr_sql(source: str, names: Sequence[str], f: str = "corr({a}, {b})") -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {f.format(a=a, b=b)} AS r FROM {source}"
        for i, a in enumerate(names) for b in names[i + 1:])


@query(f"SELECT feature_a, feature_b, round(r, 6) AS r FROM ({_corr_sql('lineitem', fx.LINE_NUMERIC)})")
def correlation_matrix(spark, sf):
    out = moments.correlation_matrix(fx.table(spark, sf, "lineitem"), fx.LINE_NUMERIC)
    return rounded(out.select("feature_a", "feature_b", "r"))


WHOLE_TWIN = [*fx.PART_WHOLE, "twin"]


@query(f"""WITH {fx.PART_SQL}
SELECT feature_a, feature_b, round(r, 6) AS r FROM ({_corr_sql("parts", WHOLE_TWIN)}) WHERE abs(r) > 0.25""")
def correlation_edges(spark, sf):
    out = moments.correlation_edges(_parts(spark, sf), WHOLE_TWIN, 0.25)
    return rounded(out.select("feature_a", "feature_b", "r"))


COSINE_COLUMNS = "sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b}))"


@query(f"""SELECT feature_a, feature_b, round(r, 6) AS cosine
FROM ({_corr_sql("lineitem", fx.LINE_NUMERIC, COSINE_COLUMNS)})""")
def column_cosine(spark, sf):
    out = moments.column_cosine(fx.table(spark, sf, "lineitem"), fx.LINE_NUMERIC)
    return rounded(out.select("feature_a", "feature_b", "cosine"))


# --- folds, metrics, linear models ------------------------------------------------------


def _folds(df: DataFrame) -> DataFrame:
    return folds.stratified_folds(df, fx.FOLD_CUT, fx.FOLD_SPLITS, fx.FOLD_REPEATS, fx.SEED)


@query(f"WITH {fx.PART_SQL}, {fx.fold_sql()} SELECT id, repeat, fold FROM folds")
def stratified_folds(spark, sf):
    return _folds(_kept(_parts(spark, sf), []))


def _preds(spark, sf) -> DataFrame:
    df = _kept(_parts(spark, sf), ["avg_qty"])
    return _folds(df).join(df, ID).select(
        F.lit("fixed").alias("model"), ID, "repeat", "fold", F.col(TARGET).alias("actual"),
        (2 * F.col("avg_qty") + 5).alias("prediction")).persist()  # scores read it three times


METRIC_SQL = {
    "r2_score": "1 - sum(power(actual - prediction, 2)) / count(*) / var_pop(actual)",
    "explained_variance": "1 - var_pop(actual - prediction) / var_pop(actual)",
    "mean_sq_error": "avg(power(actual - prediction, 2))",
    "root_mean_sq_error": "sqrt(avg(power(actual - prediction, 2)))",
    "mean_absolute_error": "avg(abs(actual - prediction))",
    "median_absolute_error": "median(abs(actual - prediction))"}
FOLD_METRICS = " UNION ALL ".join(
    f"SELECT model, repeat, fold, '{m}' AS metric, {e} AS value FROM preds GROUP BY model, repeat, fold"
    for m, e in METRIC_SQL.items())


@query(f"""WITH {fx.PRED_SQL}
SELECT model, repeat, fold, metric, round(value, 6) AS value FROM ({FOLD_METRICS})""")
def fold_metrics(spark, sf):
    return rounded(metrics.fold_metrics(_preds(spark, sf)))


@query(f"""WITH {fx.PRED_SQL}
SELECT model, metric, round(avg(value), 6) AS value FROM ({FOLD_METRICS}) GROUP BY model, metric""")
def mean_metrics(spark, sf):
    return rounded(metrics.mean_metrics(metrics.fold_metrics(_preds(spark, sf))))


@query(f"""WITH {fx.PRED_SQL}
SELECT model, id, round(sum(prediction) / {fx.FOLD_REPEATS}, 6) AS prediction FROM preds GROUP BY model, id""")
def cv_predict_mean(spark, sf):
    return rounded(metrics.cv_predict_mean(_preds(spark, sf), fx.FOLD_REPEATS))


LABEL_KEYS = ["repeat", "fold"]
AUC_SQL = """
auc AS (
  SELECT repeat, fold, sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * sum(neg), 0) AS roc_auc
  FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY repeat, fold ORDER BY s
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT repeat, fold, {s} AS s, count(*) FILTER (actual = 1) AS pos,
                     count(*) FILTER (actual = 0) AS neg FROM labelled GROUP BY 1, 2, 3))
  GROUP BY repeat, fold)"""


@query(f"""WITH {fx.LABEL_SQL}, {AUC_SQL.format(s="predicted")},
clipped AS (SELECT *, greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, predicted::DOUBLE)) AS p FROM labelled),
ll AS (SELECT repeat, fold, -avg(CASE WHEN actual = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss
       FROM clipped GROUP BY repeat, fold)
SELECT repeat, fold, round(log_loss, 6) AS log_loss, round(roc_auc, 6) AS roc_auc
FROM ll JOIN auc USING (repeat, fold)""")
def label_metrics(spark, sf):
    return rounded(metrics.label_metrics(fx.label_table(spark, sf), LABEL_KEYS))


@query(f"""WITH {fx.LABEL_SQL}, {AUC_SQL.format(s="score")}
SELECT repeat, fold, round(roc_auc, 6) AS roc_auc FROM auc""")
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(fx.label_table(spark, sf), LABEL_KEYS, "score"))


CELL_SQL = f"""{fx.LABEL_SQL},
cells AS (
  SELECT g.repeat, g.fold, a.v AS actual, b.v AS predicted,
         count(*) FILTER (l.actual = a.v AND l.predicted = b.v) AS n
  FROM (SELECT DISTINCT repeat, fold FROM labelled) g, (VALUES (1), (0)) a(v), (VALUES (1), (0)) b(v),
       labelled l WHERE l.repeat = g.repeat AND l.fold = g.fold GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {CELL_SQL} SELECT repeat, fold, actual, predicted, n FROM cells")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(fx.label_table(spark, sf), LABEL_KEYS)


@query(f"WITH {CELL_SQL} SELECT actual, predicted, round(avg(n), 6) AS n FROM cells GROUP BY actual, predicted")
def mean_confusion(spark, sf):
    return rounded(metrics.mean_confusion(metrics.confusion_matrix(fx.label_table(spark, sf), LABEL_KEYS)))


REPORT_SQL = " UNION ALL ".join(f"""
SELECT repeat, fold, {c} AS label,
       coalesce(round(h / nullif(h + fp, 0)::DOUBLE, 6), 0) AS precision,
       coalesce(round(h / nullif(h + fn, 0)::DOUBLE, 6), 0) AS recall,
       coalesce(round(2 * h / nullif(2 * h + fp + fn, 0)::DOUBLE, 6), 0) AS f1, h + fn AS support
FROM (SELECT repeat, fold, count(*) FILTER (actual = {c} AND predicted = {c}) AS h,
             count(*) FILTER (actual = {1 - c} AND predicted = {c}) AS fp,
             count(*) FILTER (actual = {c} AND predicted = {1 - c}) AS fn
      FROM labelled GROUP BY repeat, fold)""" for c in (1, 0))


@query(f"WITH {fx.LABEL_SQL} {REPORT_SQL}")
def class_report(spark, sf):
    cells = metrics.confusion_matrix(fx.label_table(spark, sf), LABEL_KEYS)
    return rounded(metrics.class_report(cells, LABEL_KEYS))


@query(f"""WITH {fx.PART_SQL}
SELECT round(regr_slope(y, avg_qty), 6) AS coef, round(regr_intercept(y, avg_qty), 6) AS intercept
FROM parts WHERE y IS NOT NULL""")
def ols_fit(spark, sf):
    model = linear.fit_gram(matrix(fx.part_table(spark, sf), ["avg_qty"]))
    return spark.createDataFrame([(round(model.coef[0], 6), round(model.intercept, 6))],
                                 "coef double, intercept double")


@query(f"""WITH {fx.PART_SQL},
fit AS (SELECT regr_slope(y, avg_qty) AS w, regr_intercept(y, avg_qty) AS b FROM parts WHERE y IS NOT NULL)
SELECT id, round(b + w * avg_qty, 6) AS prediction FROM parts, fit WHERE y IS NULL""")
def predict_target(spark, sf):
    df = _kept(_parts(spark, sf), ["avg_qty"])
    scaler = scaling.fit_scaler(df, ["avg_qty", TARGET])
    scaled = scaling.standardize(df, scaler)
    model = linear.fit_gram(matrix(scaled, ["avg_qty"]))
    out = linear.predict(clean.test_rows(scaled), model, lambda v: scaler.invert(TARGET, v))
    return rounded(out.select(ID, "prediction"))


@query(f"""WITH {fx.PART_SQL}
SELECT round(regr_r2(y, avg_qty), 6) AS r2 FROM parts WHERE y IS NOT NULL""")
def train_r2(spark, sf):
    m = matrix(_parts(spark, sf), ["avg_qty"])
    return rounded(validate.train_r2(m, linear.fit_gram(m)))


# --- runs -------------------------------------------------------------------------------

RUN_COLUMNS = [f"run_{i}" for i in range(1, 8)]


def _tagged(df: DataFrame) -> DataFrame:
    return df.withColumn("run", F.concat(F.lit("run_"), F.col("run_id").cast("string")))


@query(f"WITH {fx.RUNS_SQL} SELECT id, " + ", ".join(
    f"max(prediction) FILTER (run_id = {i}) AS run_{i}" for i in range(1, 8))
    + " FROM run_preds GROUP BY id")
def run_pivot(spark, sf):
    return runlog.wide_runs(_tagged(fx.run_predictions(spark, sf)), ID, "prediction", RUN_COLUMNS)


@query(f"WITH {fx.COEFS_SQL} SELECT feature, " + ", ".join(
    f"(count(*) FILTER (run_id = {i}))::INT AS run_{i}" for i in range(1, 8))
    + " FROM coefs GROUP BY feature")
def run_flags(spark, sf):
    return runlog.selected_flags(_tagged(fx.run_coefs(spark, sf)), RUN_COLUMNS)


@query(f"""WITH {fx.RUNS_SQL}
SELECT printf('%d_feats_%.2f_rmse', n_feats, rmse) AS run, n_feats AS size, rmse AS score, count(*) AS n
FROM run_preds GROUP BY n_feats, rmse""")
def run_name_parse(spark, sf):
    named = runlog.named_runs(fx.run_predictions(spark, sf)).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return named.select("run", run_size(F.col("run")).alias("size"), run_rmse(F.col("run")).alias("score"), "n")


INTERVAL_SQL = f"""{fx.RUNS_SQL},
spans AS (
  SELECT id, count(prediction) AS n, avg(prediction) AS mean, stddev_samp(prediction) AS sd,
         2.576 * stddev_samp(prediction) / sqrt(count(prediction)) AS half
  FROM run_preds GROUP BY id)"""


@query(f"""WITH {INTERVAL_SQL}
SELECT id, n, round(mean - half, 5) AS low, round(mean, 5) AS mean, round(mean + half, 5) AS high,
       round(sd, 5) AS sd FROM spans""")
def run_interval(spark, sf):
    return rounded(run_ops.prediction_intervals(fx.run_predictions(spark, sf)), 5)


@query(f"""WITH {INTERVAL_SQL}
SELECT id, round(mean, 5) AS mean, round(2 * half, 5) AS width FROM spans
ORDER BY abs(mean), 2 * half, id LIMIT 10""")
def run_rank(spark, sf):
    spans = run_ops.prediction_intervals(fx.run_predictions(spark, sf))
    return rounded(run_ops.rank_entities(spans).select(ID, "mean", "width").limit(10), 5)


@query(f"""WITH {fx.COEFS_SQL}
SELECT feature, round(count(*) FILTER (coef <> 0) / (SELECT count(DISTINCT run_id) FROM coefs)::DOUBLE, 6)
       AS selected_percent FROM coefs GROUP BY feature""")
def run_selected_share(spark, sf):
    coefs = fx.run_coefs(spark, sf)
    out = run_ops.feature_importance(coefs, run_ops.n_runs(coefs))
    return rounded(out.select("feature", "selected_percent"))


@query(f"""WITH {fx.RUNS_SQL},
actuals AS (SELECT l_partkey AS id, sum(round(l_extendedprice * 100)) / (sum(l_quantity) * 100.0::DOUBLE) AS actual
            FROM lineitem GROUP BY l_partkey)
SELECT run_id, round(r2, 6) AS r2 FROM (
  SELECT run_id, power(corr(prediction, actual), 2) AS r2 FROM run_preds JOIN actuals USING (id) GROUP BY run_id)
WHERE r2 >= {MIN_R2}""")
def run_filter(spark, sf):
    return rounded(run_ops.good_runs(fx.run_scores(spark, sf), MIN_R2))


IMPORTANCE_SQL = f"""{fx.COEFS_SQL},
dense AS (
  SELECT f.feature, coalesce(c.coef, 0) AS coef
  FROM (SELECT DISTINCT feature FROM coefs) f, (SELECT DISTINCT run_id FROM coefs) r
  LEFT JOIN coefs c ON c.feature = f.feature AND c.run_id = r.run_id),
importance AS (
  SELECT feature, count(*) FILTER (coef <> 0) / count(*)::DOUBLE AS selected_percent,
         avg(coef) - 2.576 * stddev_samp(coef) / sqrt(count(*)) AS min_99_coef, avg(coef) AS coef_mean,
         avg(coef) + 2.576 * stddev_samp(coef) / sqrt(count(*)) AS max_99_coef
  FROM dense GROUP BY feature)"""
IMPORTANCE = ("feature, round(selected_percent, 6) AS selected_percent, round(min_99_coef, 8) AS min_99_coef, "
              "round(coef_mean, 8) AS coef_mean, round(max_99_coef, 8) AS max_99_coef")


@query(f"WITH {IMPORTANCE_SQL} SELECT {IMPORTANCE} FROM importance")
def feature_importance(spark, sf):
    coefs = fx.run_coefs(spark, sf)
    out = run_ops.sorted_importance(run_ops.feature_importance(coefs, run_ops.n_runs(coefs)))
    return rounded(rounded(out, only=["selected_percent"]), 8)


@query(f"""WITH {IMPORTANCE_SQL}
SELECT {IMPORTANCE} FROM importance ORDER BY importance.coef_mean DESC, feature LIMIT 10""")
def top_features(spark, sf):
    coefs = fx.run_coefs(spark, sf)
    out = run_ops.feature_importance(coefs, run_ops.n_runs(coefs))
    return rounded(rounded(run_ops.top_features(out, "coef_mean"), only=["selected_percent"]), 8)


@query(f"WITH {fx.COEFS_SQL} SELECT run_id, count(*) FILTER (coef > 0) AS n_positive FROM coefs GROUP BY run_id")
def positive_coefficients(spark, sf):
    return run_ops.positive_coefficients(fx.run_coefs(spark, sf))


@query("""
SELECT p_brand AS feature, round(score, 6) AS score FROM (
  SELECT p_brand, sum(round(l_discount * 100)) / (count(*) * 100.0::DOUBLE) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand) ORDER BY score, feature LIMIT 1""")
def best_candidate(spark, sf):
    lines, parts = fx.table(spark, sf, "lineitem"), fx.table(spark, sf, "part")
    scores = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy(
        F.col("p_brand").alias("feature")).agg(
        (F.sum(F.round(F.col("l_discount") * 100)) / (F.count(F.lit(1)) * F.lit(100.0))).alias("score"))
    return rounded(search.best_candidate(scores))


# --- similarity and trees over rows -----------------------------------------------------


def _vectors(spark, sf) -> Matrix:
    return Matrix(fx.vector_table(spark, sf), tuple(f"e{i}" for i in range(64)))


ROW_PAIRS = f"""{fx.VECTOR_SQL},
listed AS (SELECT DISTINCT id, f, count(*) OVER (PARTITION BY f) AS copies FROM vecs),
pairs AS (
  SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.f, b.f) AS cosine,
         a.copies AS n_src, b.copies AS n_dst
  FROM listed a JOIN listed b ON a.id < b.id WHERE list_cosine_similarity(a.f, b.f) >= {MIN_COSINE})"""
PAIR_SQL = f"""{fx.VECTOR_SQL},
reps AS (SELECT f, {{y}} min(id) AS id, count(*) AS copies FROM vecs GROUP BY ALL),
pairs AS (
  SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.f, b.f) AS cosine,
         a.copies AS n_src, b.copies AS n_dst {{ys}}
  FROM reps a JOIN reps b ON a.id < b.id WHERE list_cosine_similarity(a.f, b.f) >= {MIN_COSINE})"""
MEASURED = PAIR_SQL.format(y="y,", ys=", a.y AS y_src, b.y AS y_dst") + """,
ratios AS (SELECT *, 1 - abs(y_src - y_dst) / nullif(y_src + y_dst, 0) AS ratio FROM pairs),
measured AS (SELECT *, cosine * ratio AS interaction,
                    1 - abs(cosine - ratio) / nullif(cosine + ratio, 0) AS overall FROM ratios)"""


@query(f"WITH {ROW_PAIRS} SELECT src, dst, round(cosine, 6) AS cosine, n_src, n_dst FROM pairs")
def cosine_pairs(spark, sf):
    m = _vectors(spark, sf)
    return rounded(similarity.cosine_pairs(m, MIN_COSINE, rows=similarity.every_row(m)))


def _measured(spark, sf) -> DataFrame:
    return similarity.with_measures(similarity.cosine_pairs(_vectors(spark, sf), MIN_COSINE, with_target=True))


@query(f"""WITH {fx.PART_SQL},
levels AS (SELECT y, count(*) AS n FROM parts WHERE y IS NOT NULL GROUP BY y),
p AS (SELECT a.y AS y_low, b.y AS y_high, 1 - abs(a.y - b.y) / (a.y + b.y) AS ratio,
             CASE WHEN a.y = b.y THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS n_pairs
      FROM levels a JOIN levels b ON a.y <= b.y)
SELECT y_low, y_high, round(ratio, 6) AS ratio, n_pairs::BIGINT AS n_pairs
FROM p WHERE ratio >= {MIN_RATIO} AND n_pairs > 0""")
def ratio_similarity(spark, sf):
    return rounded(similarity.ratio_levels(_parts(spark, sf), MIN_RATIO), only=["ratio"])


@query(f"""WITH {MEASURED}
SELECT src, dst, round(ratio, 6) AS ratio, round(interaction, 6) AS interaction FROM measured""")
def interaction_similarity(spark, sf):
    return rounded(_measured(spark, sf).select("src", "dst", "ratio", "interaction"))


@query(f"WITH {MEASURED} SELECT src, dst, round(overall, 6) AS overall FROM measured")
def overall_similarity(spark, sf):
    return rounded(_measured(spark, sf).select("src", "dst", "overall"))


@query(f"""WITH {fx.VECTOR_SQL},
listed AS (SELECT DISTINCT id, y, f FROM vecs),
m AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.f, b.f) AS c,
             1 - abs(a.y - b.y) / nullif(a.y + b.y, 0) AS r
      FROM listed a JOIN listed b ON a.id < b.id)
SELECT src, dst, (1 - abs(c - r) / nullif(c + r, 0) <= 0.5)::INT AS anomaly FROM m""")
def anomaly_pairs(spark, sf):
    return similarity.anomaly_pairs(_vectors(spark, sf))


@query(f"""WITH {fx.VECTOR_SQL},
m AS (SELECT a.id, list_cosine_similarity(a.f, b.f) AS c, 1 - abs(a.y - b.y) / nullif(a.y + b.y, 0) AS r
      FROM vecs a, vecs b)
SELECT id, count(*) FILTER (1 - abs(c - r) / nullif(c + r, 0) <= 0.5) AS degree FROM m GROUP BY id""")
def anomaly_degree(spark, sf):
    return similarity.anomaly_degree(_vectors(spark, sf))


@query(f"""WITH {fx.VECTOR_SQL}
SELECT a.id, round(1 / sum(1 - list_cosine_similarity(a.f, b.f)), 9) AS closeness FROM vecs a, vecs b GROUP BY a.id""")
def closeness(spark, sf):
    return rounded(similarity.closeness(_vectors(spark, sf)), 9)


@query(f"""WITH {fx.VECTOR_SQL}, anchor AS (SELECT f AS g FROM vecs WHERE id = 0)
SELECT id, round(list_cosine_similarity(f, g), 6) AS cosine FROM vecs, anchor WHERE id <> 0
ORDER BY list_cosine_similarity(f, g) DESC, id LIMIT 10""")
def nearest_to(spark, sf):
    return rounded(similarity.nearest_to(_vectors(spark, sf), 0, 10))


@query()
def spanning_tree(spark, sf):
    return spanning.spanning_tree(_vectors(spark, sf), "overall", "similar")


@query(f"""WITH {fx.VECTOR_SQL} SELECT id, y, """ + ", ".join(f"f[{i + 1}] AS e{i}" for i in range(6))
       + " FROM vecs")  # a spanning tree touches every row
def tree_rows(spark, sf):
    m = _vectors(spark, sf)
    rows = trees.spread(m)
    return spanning.tree_rows(rows, spanning.spanning_tree(m, "cosine", "different"))


# --- fitted models, searches, validation ------------------------------------------------


def _scaled(spark, sf, names: Sequence[str] = fx.PART_MODEL) -> recipes.Prepared:
    """The part table in model units."""
    return recipes.scale_all(_kept(_parts(spark, sf), list(names)))


def _coefficients(spark, model: linear.LinearModel) -> DataFrame:
    return model.coefficients(spark).unionByName(
        spark.createDataFrame([("(intercept)", model.intercept)], "feature string, coef double"))


@query()
def linear_svr(spark, sf):
    return _coefficients(spark, linear.linear_svr(_scaled(spark, sf).matrix()))


@query()
def linear_svr_squared(spark, sf):
    return _coefficients(spark, linear.linear_svr_squared(_scaled(spark, sf).matrix()))


@query()
def huber_l1(spark, sf):
    p = _scaled(spark, sf)
    m = trees.pca(p.df, p.names)
    kept = profile.feature_names(profile.select_k(trees.spread(m), m.names, 5))
    return _coefficients(spark, linear.huber_l1(trees.subset(m, kept)))


@query()
def ridge_grid(spark, sf):
    p = _scaled(spark, sf)
    held = folds.with_folds(p.matrix().df, _folds(_parts(spark, sf)))
    return linear.ridge_grid(Matrix(held, tuple(p.names)), fx.FOLD_REPEATS, fx.FOLD_SPLITS)


ONE = "avg_qty"
#: Moments of one feature over the training rows, centred.
MOMENTS = f"""moments AS (
  SELECT count(*) AS n, avg({ONE}) AS mx, avg(y) AS my, covar_pop(y, {ONE}) AS sxy, var_pop({ONE}) AS sxx
  FROM parts WHERE y IS NOT NULL)"""


def _one(spark, sf) -> Matrix:
    return matrix(_kept(_parts(spark, sf), [ONE]), [ONE])


@query(f"""WITH {fx.PART_SQL}, {MOMENTS}, w AS (SELECT n * sxy / (n * sxx + 10) AS w, mx, my FROM moments)
SELECT '{ONE}' AS feature, round(w, 6) AS coef FROM w UNION ALL SELECT '(intercept)', round(my - w * mx, 6) FROM w""")
def ridge_one(spark, sf):
    return rounded(_coefficients(spark, linear.fit_gram(_one(spark, sf), alpha=10.0)))


@query(f"""WITH {fx.PART_SQL}, {MOMENTS},
w AS (SELECT sign(sxy) * greatest(abs(sxy) - 0.5, 0) / sxx AS w, mx, my FROM moments)
SELECT '{ONE}' AS feature, round(w, 6) AS coef FROM w UNION ALL SELECT '(intercept)', round(my - w * mx, 6) FROM w""")
def lasso_one(spark, sf):
    return rounded(_coefficients(spark, linear.fit_gram(_one(spark, sf), l1=0.5)))


@query(f"""WITH {fx.PART_SQL}, {fx.fold_sql()},
held AS (SELECT repeat, fold, y, {ONE} AS x FROM parts JOIN folds USING (id)),
keys AS (SELECT DISTINCT repeat, fold FROM held), alphas AS (SELECT unnest([1.0, 2.0, 5.0, 10.0, 200.0])::DOUBLE AS alpha),
fits AS (SELECT k.repeat, k.fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(y, x) AS sxy, var_pop(x) AS sxx
         FROM keys k JOIN held h ON h.repeat = k.repeat AND h.fold <> k.fold GROUP BY 1, 2),
w AS (SELECT repeat, fold, alpha, n * sxy / (n * sxx + alpha) AS w, mx, my FROM fits, alphas),
s AS (SELECT w.alpha, h.repeat, h.fold, sqrt(avg(pow(y - my - w.w * (x - mx), 2))) AS rmse,
             1 - avg(pow(y - my - w.w * (x - mx), 2)) / var_pop(y) AS r2
      FROM w JOIN held h ON h.repeat = w.repeat AND h.fold = w.fold GROUP BY 1, 2, 3)
SELECT alpha, round(avg(rmse), 6) AS rmse, round(avg(r2), 6) AS r2 FROM s GROUP BY alpha""")
def ridge_grid_one(spark, sf):
    m = _one(spark, sf)
    held = folds.with_folds(m.df, _folds(_parts(spark, sf)))
    return rounded(linear.ridge_grid(Matrix(held, m.names), fx.FOLD_REPEATS, fx.FOLD_SPLITS), only=["rmse", "r2"])


@query(f"""WITH {fx.PART_SQL},
z AS (SELECT id, (avg_qty - avg(avg_qty) OVER ()) / stddev_pop(avg_qty) OVER () AS a,
             (avg_price - avg(avg_price) OVER ()) / stddev_pop(avg_price) OVER () AS b FROM parts),
r AS (SELECT sign(corr(a, b)) AS s FROM z)
SELECT id, round(abs(a + s * b) / sqrt(2), 6) AS first, round(abs(a - s * b) / sqrt(2), 6) AS second FROM z, r""")
def pca_pair(spark, sf):
    wide = trees.spread(trees.pca(_kept(_parts(spark, sf), ["avg_qty", "avg_price"]), ["avg_qty", "avg_price"]))
    return rounded(wide.select(ID, F.abs("pc_1").alias("first"), F.abs("pc_2").alias("second")),
                   only=["first", "second"])


@query()
def lasso(spark, sf):
    return _coefficients(spark, linear.fit_gram(_scaled(spark, sf).matrix(), l1=0.1))


@query()
def pca(spark, sf):
    return trees.spread(trees.pca(_kept(_parts(spark, sf), fx.PART_MODEL), fx.PART_MODEL))


GROUP_COLUMNS = ", ".join(f"({i}, '{c}')" for i, c in enumerate(WHOLE_TWIN))


@query(f"""WITH RECURSIVE {fx.PART_SQL}, cols(i, feature) AS (VALUES {GROUP_COLUMNS}),
edges AS (SELECT a.i AS a, b.i AS b FROM ({_corr_sql("parts", WHOLE_TWIN, "corr({a}, {b}) FILTER (y IS NOT NULL)")}) e
          JOIN cols a ON a.feature = feature_a JOIN cols b ON b.feature = feature_b WHERE abs(r) > 0.91),
before AS (SELECT i, coalesce(list(a) FILTER (a IS NOT NULL), []) AS firsts FROM cols LEFT JOIN edges ON b = i GROUP BY i),
walk(i, leaders) AS (
  SELECT 0, [0] UNION ALL
  SELECT w.i + 1, CASE WHEN list_has_any(w.leaders, p.firsts) THEN w.leaders ELSE list_append(w.leaders, p.i) END
  FROM walk w JOIN before p ON p.i = w.i + 1),
leads AS (SELECT unnest(leaders) AS lead FROM walk WHERE i = (SELECT max(i) FROM walk)),
members AS (SELECT lead, b AS i FROM leads JOIN edges ON a = lead UNION ALL SELECT lead, lead FROM leads)
SELECT (dense_rank() OVER (ORDER BY lead) - 1)::INT AS group_id, feature,
       (row_number() OVER (PARTITION BY lead ORDER BY m.i = lead, m.i) - 1)::INT AS position
FROM members m JOIN cols ON cols.i = m.i""")
def correlation_groups(spark, sf):
    df = _parts(spark, sf)
    edges = moments.correlation_edges(clean.train_rows(df), WHOLE_TWIN, 0.91)
    pairs = [(r["feature_a"], r["feature_b"]) for r in edges.collect()]
    return search.groups_table(spark, search.correlation_groups(WHOLE_TWIN, pairs))


def _search_input(spark, sf) -> tuple[recipes.Prepared, Matrix, list[list[str]]]:
    df = _kept(_parts(spark, sf), SEARCHED)
    p = recipes.Recipe("search", recipes.unchanged, engineer.nonlinear_expand).prepare(df)
    arrays = _folds(df).groupBy(ID).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("repeat", "fold"))), lambda s: s["fold"]).alias("folds"))
    m = p.matrix()
    held = Matrix(m.df.join(arrays, ID, "left").persist(), m.names)
    edges = moments.correlation_edges(p.train, p.names, 0.99)
    pairs = [(r["feature_a"], r["feature_b"]) for r in edges.collect()]
    return p, held, search.correlation_groups(p.names, pairs)


@query()
def mixed_stepwise(spark, sf):
    _, m, groups = _search_input(spark, sf)
    scorer = search.RidgeScorer(m, fx.FOLD_REPEATS, fx.FOLD_SPLITS)
    start = search.init_features(groups, 3, fx.SEED)
    return search.mixed_stepwise(scorer, groups, 10, start, fx.SEED).steps(spark)


@query()
def robust_runs(spark, sf):
    p, m, groups = _search_input(spark, sf)
    scorer = search.RidgeScorer(m, fx.FOLD_REPEATS, fx.FOLD_SPLITS)
    final = search.SvrScorer(m, fx.FOLD_REPEATS, fx.FOLD_SPLITS)
    _, predictions = search.robust_runs(m, scorer, groups, 2, 4, fx.SEED, invert=p.invert, final=final)
    return run_ops.prediction_intervals(predictions)


@query()
def random_forest(spark, sf):
    m = _scaled(spark, sf).matrix()
    return trees.predict_ml(m, trees.random_forest(m, trees=10, depth=4))


@query()
def gradient_boosting(spark, sf):
    m = _scaled(spark, sf).matrix()
    return trees.predict_ml(m, trees.gradient_boosting(m, rounds=5))


@query()
def adaboost(spark, sf):
    m = _scaled(spark, sf).matrix()
    return trees.predict_ml(m, trees.adaboost(m, rounds=4))


@query()
def kernel_svr(spark, sf):
    m = _scaled(spark, sf).matrix()
    features, model = trees.kernel_svr(m, components=50)
    return features.df.select(ID, TARGET, model.array_column(features.names).alias("prediction"))


@query()
def score_regressor(spark, sf):
    p = _scaled(spark, sf)
    return validate.score_regressor(p, p.names, models.LeastSquares(), fx.FOLD_CUT, "ols",
                                    fx.FOLD_SPLITS, fx.FOLD_REPEATS, fx.SEED).folds


@query()
def score_classifier(spark, sf):
    rows = fx.label_table(spark, sf).select(ID, "actual", "score")
    estimator = LogisticRegression(featuresCol=trees.VECTOR, labelCol="label", maxIter=10)
    return validate.score_classifier(rows, ["score"], "actual", estimator, 3, 2, fx.SEED).folds


@query()
def leaderboard(spark, sf):
    df = _kept(_parts(spark, sf), ["avg_qty", "avg_disc", "avg_tax", "twin"])
    specs = [models.model("template"), models.model("best_svr", ["avg_qty", "avg_qty*avg_disc"]),
             models.model("linear_reg")]
    return validate.leaderboard(df, specs, fx.FOLD_CUT, fx.FOLD_SPLITS, 2)[0]


# --- profiles in array form (D4, D5) ----------------------------------------------------

DISCRETE = ("p_size", "n_lines")  # the integer columns of the part table
WIDE_RAW = " UNION ALL ".join(
    f"SELECT id, y, '{c}' AS feature, {k} AS k, "
    f"CASE WHEN isnan({c}::DOUBLE) OR isinf({c}::DOUBLE) THEN NULL ELSE {c}::DOUBLE END AS value, "
    f"{str(c in DISCRETE).upper()} AS discrete FROM parts" for k, c in enumerate(fx.PART_NUMERIC))
WIDE_CLEAN = f"""{fx.PART_SQL},
raw AS ({WIDE_RAW}),
vary AS (SELECT feature FROM raw GROUP BY feature HAVING stddev_samp(value) > 0 AND count(value) = count(*)),
kept AS (SELECT r.* FROM raw r JOIN vary USING (feature)),
levels AS (SELECT DISTINCT feature, value AS level FROM kept WHERE discrete AND value IS NOT NULL),
clean AS (
  SELECT id, y, feature, k, value FROM kept WHERE NOT discrete
  UNION ALL
  SELECT c.id, c.y, c.feature || '_' || l.level::BIGINT, 1000 + c.k, CASE WHEN c.value = l.level THEN 1.0 ELSE 0.0 END
  FROM kept c JOIN levels l ON c.feature = l.feature)"""
WIDE_SUMS = """scale AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM made WHERE y IS NOT NULL GROUP BY feature)
SELECT feature, count(value) AS n, round(sum((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END), 6) AS total
FROM made JOIN scale USING (feature) GROUP BY feature"""
#: The gates of the transforms and their SQL, as in ``GATES``.
WIDE_GATES = {"log": ("lo > 0", "ln(value)"), "log2": ("lo > 0", "log2(value)"), "log10": ("lo > 0", "log10(value)"),
              "cubert": ("lo > 0", "cbrt(value)"), "sqrt": ("lo > 0", "sqrt(value)"), "exp": ("hi < 13", "exp(value)"),
              "exp2": ("hi < 20", "power(2.0::DOUBLE, value)"), "cube": ("hi < 100", "value * value * value"),
              "sq": ("hi < 1000", "value * value")}
WIDE_MADE = " UNION ALL ".join(
    f"SELECT id, y, feature || '_{s}' AS feature, {expr} AS value FROM kept JOIN gates USING (feature) "
    f"WHERE NOT discrete AND {gate}" for s, (gate, expr) in WIDE_GATES.items())


@query(f"""WITH {WIDE_CLEAN},
gates AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM kept WHERE NOT discrete GROUP BY feature),
made AS (SELECT id, y, feature, value FROM clean UNION ALL {WIDE_MADE}),
{WIDE_SUMS}""")
def wide_non_linear(spark, sf):
    """Profile ``non_linear`` in array form: per prepared feature, its values and their sum."""
    return rounded(wide.feature_sums(wide.non_linear(_parts(spark, sf))))


#: Fixed value: the normal quantile at 0.995, for the two-sided 1% F test of the products.
Z_995 = 2.5758293035489004
# t quantile by the Cornish-Fisher expansion in 1/nu (Abramowitz and Stegun 26.7.5)
T_CRIT = ("(z + (z^3 + z) / (4 * nu) + (5 * z^5 + 16 * z^3 + 3 * z) / (96 * nu^2)"
          " + (3 * z^7 + 19 * z^5 + 17 * z^3 - 15 * z) / (384 * nu^3)"
          " + (79 * z^9 + 776 * z^7 + 1482 * z^5 - 1920 * z^3 - 945 * z) / (92160 * nu^4))")


@query(f"""WITH {WIDE_CLEAN},
vary2 AS (SELECT feature FROM clean GROUP BY feature HAVING stddev_samp(value) > 0 AND count(value) = count(*)),
many AS (SELECT feature FROM clean JOIN vary2 USING (feature) GROUP BY feature HAVING count(DISTINCT value) > 3),
long AS (SELECT c.id, c.y, c.y IS NULL AS is_test, c.feature, c.k, c.value FROM clean c JOIN many USING (feature)),
vals AS (
  SELECT feature, value, count(*) FILTER (is_test) AS a, count(*) FILTER (NOT is_test) AS b
  FROM long WHERE value IS NOT NULL GROUP BY feature, value),
cum AS (
  SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER t AS na, sum(b) OVER t AS nb
  FROM vals WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING),
                   t AS (PARTITION BY feature)),
gap AS (
  SELECT feature, max(na)::BIGINT AS n_test, max(nb)::BIGINT AS n_train,
         max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)) AS d
  FROM cum GROUP BY feature),
ks AS (
  SELECT *, (sqrt(n_test::DOUBLE * n_train / (n_test + n_train)) + 0.12
             + 0.11 / sqrt(n_test::DOUBLE * n_train / (n_test + n_train))) * d AS lam FROM gap),
ksp AS (
  SELECT feature, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0,
           list_sum(list_transform(range(1, 21), lambda j:
             (CASE WHEN j % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END)
             * exp(-2.0::DOUBLE * j * j * lam * lam))))) END AS p_value
  FROM ks),
base AS (SELECT l.id, l.y, l.feature, l.k, l.value FROM long l JOIN ksp USING (feature) WHERE p_value > 0.10),
st AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM base WHERE y IS NOT NULL GROUP BY feature),
z AS (SELECT b.id, b.y, b.feature, b.k, (b.value - st.m) / CASE WHEN st.s = 0 THEN 1 ELSE st.s END AS v
      FROM base b JOIN st USING (feature) WHERE b.y IS NOT NULL),
pairs AS (SELECT a.feature AS fa, b.feature AS fb, count(*) AS n, corr(a.v * b.v, a.y) AS r
          FROM z a JOIN z b ON a.id = b.id AND a.k < b.k GROUP BY a.feature, b.feature),
screened AS (SELECT fa, fb FROM (SELECT *, {Z_995}::DOUBLE AS z, (n - 2)::DOUBLE AS nu FROM pairs)
             WHERE r IS NOT NULL AND NOT isnan(r) AND r * r / (1 - r * r) * nu > power({T_CRIT}, 2)),
made AS (
  SELECT id, y, feature, value FROM base
  UNION ALL
  SELECT a.id, a.y, s.fa || '*' || s.fb, a.value * b.value
  FROM screened s JOIN base a ON a.feature = s.fa JOIN base b ON b.feature = s.fb AND a.id = b.id),
{WIDE_SUMS}""")
def wide_ks_filtered(spark, sf):
    """Profile ``ks_filtered`` in array form: per prepared feature, its values and their sum."""
    return rounded(wide.feature_sums(wide.ks_filtered(_parts(spark, sf))))
