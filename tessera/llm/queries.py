"""The subpackage's named queries, over the given tables, and their DuckDB SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import coding_report
from tessera.llm.decontaminate import find_passages
from tessera.llm.dedup import DEDUP_SQL, dedup_report
from tessera.llm.divergence import AUDIT_SQL, audit_sources
from tessera.llm.jaccard import components_sql, jaccard_report
from tessera.llm.langid import held_out_languages
from tessera.llm.lm_score import language_model_report
from tessera.llm.packing import pack
from tessera.llm.pii import personal_data_report
from tessera.llm.quality import held_out_quality
from tessera.llm.sharding import shard_report
from tessera.llm.tokencount import count_tokens
from tessera.llm.vector_codes import vector_code_report, vector_code_sql
from tessera.session import ship_package
from tessera.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query under its name; in local mode its Python workers get this package."""
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(read_table(spark, sf_dir, "documents"))


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_languages(read_table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_report(read_table(spark, sf_dir, "documents"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(read_table(spark, sf_dir, "documents"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_report(read_table(spark, sf_dir, "documents"))


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_report(read_table(spark, sf_dir, "documents"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(read_table(spark, sf_dir, "documents"))


@query
def op12_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding_report(read_table(spark, sf_dir, "documents"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_code_report(read_table(spark, sf_dir, "embeddings"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def llm_oracles() -> dict[str, str]:
    return {"op7_exact_dedup": DEDUP_SQL, "op10_jaccard_join": components_sql(),
            "op11_source_divergence": AUDIT_SQL, "op13_vector_codes": vector_code_sql()}
