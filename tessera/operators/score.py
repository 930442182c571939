"""Blending, ranking and result bookkeeping, keyed by (model, document)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import literals as L

METRICS = ["overall_score", "avg_coherence", "section_boundary_contrast", "semantic_search_precision"]


SEARCH_NUMBERS = ["semantic_search_precision", "min_precision", "max_precision", "search_precision_std"]


def overall_score(coherence: DataFrame, contrast: DataFrame, search: DataFrame | None,
                  keys: tuple[str, ...] = ("model_name", "doc"), searched: list[str] | None = None) -> DataFrame:
    """``0.3 avg_coherence + 0.3 contrast + 0.4 precision``.

    A (model, document) has a result only when coherence exists; missing
    contrast or search numbers are 0, as the evaluated toolkit reports them.
    That holds for a search that took place and found nothing to count.  Models
    outside ``searched`` (None: all are in it) had no search: its numbers and the
    blend are NULL, also where ``search`` is None.
    """
    keys = list(keys)
    j = coherence.join(contrast.drop("n_units", "n_zero_vectors"), keys, "left")
    if search is None:
        searched = []
        j = j.withColumns({"n_queries": F.lit(None).cast("long")} |
                          {c: F.lit(None).cast("double") for c in SEARCH_NUMBERS})
    else:
        j = j.join(search, keys, "left")
    of_search = [c for c in (search.columns if search is not None else ["n_queries", *SEARCH_NUMBERS]) if c not in keys]
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in j.columns
            if c not in keys and c not in coherence.columns and c not in of_search}
    measured = F.lit(True) if searched is None else F.col("model_name").isin(searched) if searched else F.lit(False)
    zero |= {c: F.when(measured, F.coalesce(F.col(c), F.lit(0))) for c in of_search}
    j = j.withColumns({c: v.cast(j.schema[c].dataType) for c, v in zero.items()})
    return j.withColumn("overall_score",
                        F.col("avg_coherence") * L.WEIGHT_COHERENCE
                        + F.col("section_boundary_contrast") * L.WEIGHT_CONTRAST
                        + F.col("semantic_search_precision") * L.WEIGHT_PRECISION)


def leaderboard(results: DataFrame, order_col: str = "model_order", group: str = "doc") -> DataFrame:
    """Models by overall score, best first; ties keep input (model) order."""
    w = Window.partitionBy(group).orderBy(F.col("overall_score").desc_nulls_last(), F.col(order_col))
    r = results.withColumn("position", F.row_number().over(w).cast("long"))
    return r.withColumn("is_best", F.col("position") == 1)


def best_per_metric(results: DataFrame, order_col: str = "model_order", group: str = "doc",
                    metrics: list[str] = METRICS) -> DataFrame:
    """Argmax model per metric, first in model order on ties; no best model
    when a score is NaN (the dashboard's rule)."""
    rows = []
    for m in metrics:
        score = F.col(m)
        agg = results.groupBy(group).agg(
            F.max_by("model_name", F.struct(score, -F.col(order_col))).alias("best_model"),
            F.max(score).alias("best_value"),
            F.count_if(F.isnan(score)).alias("_nan"))
        rows.append(agg.select(group, F.lit(m).alias("metric"),
                               F.when(F.col("_nan") == 0, F.col("best_model")).alias("best_model"),
                               F.when(F.col("_nan") == 0, F.col("best_value")).alias("best_value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def model_count(results: DataFrame, group: str = "doc") -> DataFrame:
    return results.groupBy(group).agg(
        F.count_if(F.col("model_name") != L.PLACEHOLDER_NAME).alias("n_models"))


def merge_latest(results: DataFrame, keys: list[str], run_col: str = "run_order") -> DataFrame:
    """Later run wins per key (like updating a dict)."""
    w = Window.partitionBy(*keys).orderBy(F.col(run_col).desc())
    return results.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
