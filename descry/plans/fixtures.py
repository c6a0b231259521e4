"""Descriptor tables derived from the given tables, whole, as DataFrames and as SQL.

The two forms use the same arithmetic in the same order. Averages of two-decimal values
are taken over exact whole-number sums, so both engines give the same doubles.
A missing target marks the rows to predict; no row is left out by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART_NUMERIC = ["p_size", "p_retailprice", "avg_qty", "avg_price", "avg_disc", "avg_tax",
                "max_disc", "n_lines", "const_one", "low_card", "holed", "drift", "twin"]
PART_WHOLE = ["p_size", "p_retailprice", "avg_qty", "avg_price", "avg_disc", "avg_tax",
              "max_disc", "n_lines", "drift"]
PART_MODEL = ["p_size", "p_retailprice", "avg_qty", "avg_price", "avg_disc", "avg_tax", "max_disc"]
LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FOLD_CUT = 100.0
FOLD_SPLITS = 3
FOLD_REPEATS = 10
SEED = 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str):
    """Exact average of two-decimal values."""
    return F.sum(F.round(F.col(c) * 100)) / (F.count(F.lit(1)) * F.lit(100.0))


def _unit_price():
    """Exact price per piece over a group of lines."""
    return F.sum(F.round(F.col("l_extendedprice") * 100)) / (F.sum("l_quantity") * F.lit(100.0))


def part_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        (F.sum("l_quantity") / F.count(F.lit(1))).alias("avg_qty"),
        _cents("l_extendedprice").alias("avg_price"),
        _cents("l_discount").alias("avg_disc"),
        _cents("l_tax").alias("avg_tax"),
        F.max("l_discount").alias("max_disc"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("p_size"),
        "p_retailprice")
    joined = parts.join(lines, parts["id"] == lines["l_partkey"], "inner")
    test = F.col("id") % 3 == 0
    y = (2 * F.col("avg_qty") + 50 * F.col("avg_qty") * F.col("avg_disc")
         + ((F.col("id") * 7919) % 101) / F.lit(101.0))
    return joined.select(
        "id", F.when(~test, y).alias("y"), "p_size", "p_retailprice", "avg_qty", "avg_price",
        "avg_disc", "avg_tax", "max_disc", "n_lines",
        F.lit(1.0).alias("const_one"),
        (F.col("id") % 3).cast("double").alias("low_card"),
        F.when(F.col("id") % 7 != 0, F.col("avg_tax")).alias("holed"),
        F.when(test, F.col("avg_qty") + 100).otherwise(F.col("avg_qty")).alias("drift"),
        (2 * F.col("avg_qty") + 1).alias("twin"),
    )


PART_SQL = """
lines AS (
  SELECT l_partkey, sum(l_quantity) / count(*) AS avg_qty,
         sum(round(l_extendedprice * 100)) / (count(*) * 100.0::DOUBLE) AS avg_price,
         sum(round(l_discount * 100)) / (count(*) * 100.0::DOUBLE) AS avg_disc,
         sum(round(l_tax * 100)) / (count(*) * 100.0::DOUBLE) AS avg_tax,
         max(l_discount) AS max_disc, count(*) AS n_lines
  FROM lineitem GROUP BY l_partkey),
parts AS (
  SELECT p_partkey AS id,
         CASE WHEN p_partkey % 3 <> 0 THEN 2 * avg_qty + 50 * avg_qty * avg_disc
              + ((p_partkey * 7919) % 101) / 101.0::DOUBLE END AS y,
         p_size::BIGINT AS p_size, p_retailprice, avg_qty, avg_price, avg_disc, avg_tax,
         max_disc, n_lines, 1.0::DOUBLE AS const_one, (p_partkey % 3)::DOUBLE AS low_card,
         CASE WHEN p_partkey % 7 <> 0 THEN avg_tax END AS holed,
         CASE WHEN p_partkey % 3 = 0 THEN avg_qty + 100 ELSE avg_qty END AS drift,
         2 * avg_qty + 1 AS twin
  FROM part JOIN lines ON p_partkey = l_partkey)"""


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, features array<double>."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("label") + 1).cast("double").alias("y"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


VECTOR_SQL = """
vecs AS (
  SELECT vec_id AS id, (label + 1)::DOUBLE AS y, embedding::DOUBLE[] AS f FROM embeddings)"""


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per labelled document: actual, predicted by length, repeats 0-2 of hash folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("actual"),
        (F.col("n_chars") > 1000).cast("int").alias("predicted"),
        F.col("n_chars").cast("double").alias("score"),
        F.lit(0).alias("repeat"), (F.col("doc_id") % 4).cast("int").alias("fold"),
    )


LABEL_SQL = """
labelled AS (
  SELECT d.doc_id AS id, toxic AS actual, (n_chars > 1000)::INT AS predicted,
         n_chars::DOUBLE AS score, 0 AS repeat, (d.doc_id % 4)::INT AS fold
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def fold_sql(source: str = "parts") -> str:
    return f"""
folds AS (
  SELECT id, repeat, ((row_number() OVER (PARTITION BY repeat, label ORDER BY
           md5('{SEED}' || '|' || repeat || '|' || id), id) - 1) % {FOLD_SPLITS})::INT AS fold
  FROM (SELECT id, (y < {FOLD_CUT})::INT AS label, r.repeat::INT AS repeat
        FROM {source}, (SELECT unnest(range({FOLD_REPEATS})) AS repeat) r
        WHERE y IS NOT NULL))"""


PRED_SQL = f"""{PART_SQL}, {fold_sql()},
preds AS (
  SELECT 'fixed' AS model, f.id, f.repeat, f.fold, p.y AS actual,
         2 * p.avg_qty + 5 AS prediction
  FROM folds f JOIN parts p ON f.id = p.id)"""


def run_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long run log over all lines: a run per line number, an entity per part.

    A run predicts an entity by the unit price over its lines; its size is the number of
    distinct discounts it saw and its score comes from its highest price.
    """
    lines = table(spark, sf_dir, "lineitem")
    runs = lines.groupBy(F.col("l_linenumber").alias("run_id")).agg(
        F.count_distinct("l_discount").cast("int").alias("n_feats"),
        F.round(F.max("l_extendedprice") / 10000 - F.col("run_id") * 0.25, 2).alias("rmse"),
    )
    preds = lines.groupBy(F.col("l_linenumber").alias("run_id"), F.col("l_partkey").alias("id")).agg(
        _unit_price().alias("prediction"))
    return preds.join(runs, "run_id")


RUNS_SQL = """
runs AS (
  SELECT l_linenumber AS run_id, count(DISTINCT l_discount)::INT AS n_feats,
         round(max(l_extendedprice) / 10000 - l_linenumber * 0.25, 2) AS rmse
  FROM lineitem GROUP BY l_linenumber),
run_preds AS (
  SELECT run_id, id, prediction, n_feats, rmse
  FROM (SELECT l_linenumber AS run_id, l_partkey AS id,
               sum(round(l_extendedprice * 100)) / (sum(l_quantity) * 100.0::DOUBLE) AS prediction
        FROM lineitem GROUP BY l_linenumber, l_partkey) JOIN runs USING (run_id))"""


def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, r2): squared correlation of a run's predictions with the entities' unit prices."""
    actual = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        _unit_price().alias("actual"))
    joined = run_predictions(spark, sf_dir).join(actual, "id")
    return joined.groupBy("run_id").agg(F.pow(F.corr("prediction", "actual"), 2).alias("r2"))


def run_coefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long coefficient log over all lines: a run per line number, a feature per part brand.

    The coefficient is the mean discount less five percent; a run did not select a feature
    whose coefficient is below -0.0005.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_partkey", "l_discount")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    coef = _cents("l_discount") - 0.05
    by = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy(
        F.col("l_linenumber").alias("run_id"), F.col("p_brand").alias("feature"))
    return by.agg(coef.alias("coef")).filter(F.col("coef") > -0.0005)


COEFS_SQL = """
coefs AS (
  SELECT * FROM (
    SELECT l_linenumber AS run_id, p_brand AS feature,
           sum(round(l_discount * 100)) / (count(*) * 100.0::DOUBLE) - 0.05 AS coef
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_linenumber, p_brand)
  WHERE coef > -0.0005)"""
