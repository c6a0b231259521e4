"""Reading descriptor tables, decoys and feature lists; writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from descry import ID, TARGET
from descry.functions.columns import finite, quoted


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: StructType | str | None = None) -> DataFrame:
    """Parquet, or CSV with a header. Give a schema for large CSV files: inference reads them twice."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    return reader.load(path)


def read_descriptors(spark: SparkSession, path: str, key: str, target: str | None = None,
                     fmt: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """A descriptor table with its key named ``id`` and its target named ``y`` (double)."""
    df = read_table(spark, path, fmt, schema)
    return as_descriptors(df, key, target)


def as_descriptors(df: DataFrame, key: str, target: str | None = None) -> DataFrame:
    """Names the key and the target; NaN and infinite values become null, the one sign of
    missing values from here on."""
    first = [quoted(key).alias(ID)]
    if target is not None:
        first.append(finite(quoted(target)).alias(TARGET))
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*first, *[finite(quoted(c)).alias(c) if c in floats else quoted(c)
                               for c in df.columns if c not in (key, target)])


def read_decoys(spark: SparkSession, path: str, key: str, value: float = 250.0,
                fmt: str | None = None) -> DataFrame:
    """A second table without target; every row gets the same one."""
    return with_constant_target(read_descriptors(spark, path, key, fmt=fmt), value)


def with_constant_target(df: DataFrame, value: float = 250.0) -> DataFrame:
    rest = [quoted(c) for c in df.columns if c not in (ID, TARGET)]
    return df.select(quoted(ID), F.lit(float(value)).alias(TARGET), *rest)


def read_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """One-column file of feature names, as ``feature``."""
    df = read_table(spark, path, "csv" if path.endswith(".csv") else None)
    return df.select(quoted(df.columns[0]).cast("string").alias("feature"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def stored(spark: SparkSession, df_builder, path: str) -> DataFrame:
    """Prepared table kept under ``path``: read when complete there, else built and written.

    Spark writes ``_SUCCESS`` last, so a half-written folder is rebuilt.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        df_builder().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
