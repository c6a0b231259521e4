"""The numbered queries over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.llm import (alignment, contamination, language, mixing, packing, pii, sharding, simhash,
                        tokenfiles, substrings, topk, toxicity, whitening)
from descry.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function name, with its SQL when there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


@query()
def op9_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query()
def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


@query(contamination.CONTAINED_SQL)
def op4_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


@query()
def op6_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(table(spark, sf, "documents"))


@query()
def op2_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf, "documents"))


@query()
def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query(sharding.SHARDS_SQL)
def op5_extendible_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shards(table(spark, sf, "documents"))


@query(topk.TOP_K_SQL)
def op8_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), F.col("id") % 50 == 0)


@query()
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.duplicate_passages(table(spark, sf, "documents"))


@query()
def op11_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


@query()
def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


@query()
def op13_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.alignment(table(spark, sf, "documents"))
