"""Results in the evaluated toolkit's nested shape, JSON export keyed by model,
reading such JSON back into rows, the ``empty`` placeholder, and run status.

A result document maps model name -> result for one evaluated document; it
holds one entry per model, so building it with ``collect_list`` per document
is bounded by the number of models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import literals as L

COHERENCE = ["avg_coherence", "min_coherence", "max_coherence", "coherence_std"]
BOUNDARIES = ["avg_within_section_similarity", "avg_cross_section_similarity",
              "section_boundary_contrast", "within_similarity_std", "cross_similarity_std"]
SEARCH = ["semantic_search_precision", "min_precision", "max_precision", "search_precision_std"]

RESULT_TYPE = (
    "struct<model_id:string,"
    "coherence:struct<" + ",".join(f"{c}:double" for c in COHERENCE) + ">,"
    "section_boundaries:struct<" + ",".join(f"{c}:double" for c in BOUNDARIES) + ">,"
    "semantic_search:struct<" + ",".join(f"{c}:double" for c in SEARCH) + ">,"
    "evaluation_time_seconds:double,overall_score:double>")
RESULT_MAP_TYPE = f"map<string,{RESULT_TYPE}>"


def nest(flat: DataFrame, model_id_col: str = "model_id", time_col: str | None = None) -> DataFrame:
    """Flat metric rows -> ``model_name, doc, result`` (nested struct).  The
    evaluation time is NULL unless it was measured (``time_col``)."""
    t = F.col(time_col).cast("double") if time_col else F.lit(None).cast("double")
    result = F.struct(
        F.col(model_id_col).alias("model_id"),
        F.struct(*[F.col(c).cast("double").alias(c) for c in COHERENCE]).alias("coherence"),
        F.struct(*[F.col(c).cast("double").alias(c) for c in BOUNDARIES]).alias("section_boundaries"),
        F.struct(*[F.col(c).cast("double").alias(c) for c in SEARCH]).alias("semantic_search"),
        t.alias("evaluation_time_seconds"),
        F.col("overall_score").cast("double").alias("overall_score"))
    return flat.select("model_name", "doc", result.alias("result"))


def to_json_documents(nested: DataFrame) -> DataFrame:
    """One JSON object per document, keyed by model name (bounded by #models)."""
    return nested.groupBy("doc").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_name", "result")))),
                  {"ignoreNullFields": "false"}).alias("results_json"))


def from_json_documents(docs: DataFrame, json_col: str = "results_json") -> DataFrame:
    """Model-keyed JSON -> one row per (doc, model) with the metric columns.

    Parsed with an explicit map schema: schema inference would turn every
    model name into a column.
    """
    m = F.from_json(F.col(json_col), RESULT_MAP_TYPE)
    rows = docs.select("doc", F.explode(m).alias("model_name", "r"))
    return rows.select(
        "doc", "model_name", F.col("r.model_id").alias("model_id"),
        *[F.col(f"r.coherence.{c}").alias(c) for c in COHERENCE],
        *[F.col(f"r.section_boundaries.{c}").alias(c) for c in BOUNDARIES],
        *[F.col(f"r.semantic_search.{c}").alias(c) for c in SEARCH],
        F.col("r.evaluation_time_seconds").alias("evaluation_time_seconds"),
        F.col("r.overall_score").alias("overall_score"))


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    """Read result files (each one JSON object keyed by model) into rows."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("doc"), F.col("value").alias("results_json"))
    return from_json_documents(raw)


def write_results(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite a result table; partitioned by model so readers prune."""
    rows.write.mode("overwrite").partitionBy("model_name").format(fmt).save(path)


def with_placeholder(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Every listed document without a result gets one all-zero ``empty`` row."""
    metric_cols = COHERENCE + BOUNDARIES + SEARCH + ["evaluation_time_seconds", "overall_score"]
    missing = docs.select("doc").distinct().join(rows.select("doc").distinct(), "doc", "left_anti")
    zero = missing.select("doc", F.lit(L.PLACEHOLDER_NAME).alias("model_name"),
                          F.lit(L.PLACEHOLDER_MODEL_ID).alias("model_id"),
                          *[F.lit(0.0).alias(c) for c in metric_cols])
    return rows.select("doc", "model_name", "model_id", *metric_cols).unionByName(zero)


def clean_placeholder(rows: DataFrame) -> DataFrame:
    """Drop ``empty`` where a document also has real results (at most #models
    rows per document, so the per-document count is small)."""
    real = rows.groupBy("doc").agg(F.count_if(F.col("model_name") != L.PLACEHOLDER_NAME).alias("_real"))
    return (rows.join(real, "doc")
                .filter((F.col("model_name") != L.PLACEHOLDER_NAME) | (F.col("_real") == 0))
                .drop("_real"))


def run_status(results: DataFrame, docs: DataFrame) -> DataFrame:
    """Status per document: ``completed`` with at least one model result,
    else ``error`` (the evaluated server reported completed even then)."""
    n = results.groupBy("doc").agg(F.count(F.lit(1)).alias("n_models"))
    j = docs.select("doc").distinct().join(n, "doc", "left").fillna(0, subset=["n_models"])
    ok = F.col("n_models") > 0
    return j.select(
        F.col("doc").alias("document_name"),
        F.when(ok, F.lit("completed")).otherwise(F.lit("error")).alias("status"),
        F.when(ok, F.lit("Evaluation completed successfully."))
         .otherwise(F.lit("No model produced a result.")).alias("message"),
        F.when(ok, F.lit(100)).otherwise(F.lit(0)).cast("long").alias("progress"),
        F.col("n_models").cast("long").alias("n_models"))


def processing_status(docs: DataFrame) -> DataFrame:
    """The status rows of documents whose evaluation begins."""
    return docs.select("doc").distinct().select(
        F.col("doc").alias("document_name"), F.lit("processing").alias("status"),
        F.lit("Evaluation in progress.").alias("message"), F.lit(0).cast("long").alias("progress"),
        F.lit(0).cast("long").alias("n_models"))


def error_status(docs: DataFrame, message: str) -> DataFrame:
    """The status rows of documents whose evaluation failed as a whole."""
    return processing_status(docs).withColumn("status", F.lit("error")).withColumn("message", F.lit(message))


def canonical_export(exported: DataFrame) -> DataFrame:
    """``doc, results``: of exported JSON, ``model:score`` with 6 digits, by model name (bounded by #models)."""
    rows = from_json_documents(exported)
    one = F.struct("model_name", F.format_string("%s:%.6f", "model_name", "overall_score").alias("s"))
    return rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), ",")
                                   .alias("results"))


def latest_run(history: DataFrame) -> DataFrame:
    """Last evaluated document from an append-only ``document_name,
    evaluated_at`` history (ties: greatest name)."""
    return history.agg(
        F.max_by("document_name", F.struct("evaluated_at", "document_name")).alias("last_document"),
        F.max("evaluated_at").alias("last_evaluation_time"))
