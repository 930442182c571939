"""Pair evaluation: similarity of scored text pairs and its correlation with
the score, per model.

No input table holds human scores, so pairs come from ``conversations``:
each turn with the next turn of the same conversation (an equi-join on
``(conv_id, turn + 1)``, balanced even for a huge conversation), scored by the
Jaccard overlap of their word sets.  Each turn is embedded once per model and
joined to both sides of its pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import text as T
from ..functions import vectors as V
from ..operators import correlate as X
from ..operators import embed as E
from ..sources import literals as L

SECONDS = ["load_time_seconds", "average_embedding_time_seconds"]


def conversation_pairs(conv: DataFrame) -> DataFrame:
    a = conv.select("conv_id", "turn", F.col("text").alias("text1"))
    b = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text2"))
    sa = F.array_distinct(T.words(F.col("text1")))
    sb = F.array_distinct(T.words(F.col("text2")))
    inter = F.size(F.array_intersect(sa, sb))
    union = F.size(sa) + F.size(sb) - inter
    return (a.join(b, ["conv_id", "turn"])
             .select("conv_id", "turn", "text1", "text2",
                     F.when(union > 0, inter / union).alias("human_score")))


def turn_vectors(conv: DataFrame, models=E.NATIVE_MODELS) -> DataFrame:
    """Vectors of every turn, with native models and the user's; failed turns have none."""
    units = conv.select("conv_id", "turn", "text")
    return E.embed(units, list(models)).where(F.col("error").isNull()).drop("error")


def pair_similarity(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """Both sides of each pair get their vector by equi-join; cosine per model."""
    a = vecs.select("model_name", "conv_id", "turn", "dim",
                    *[F.col(c).alias("a_" + c) for c in ("vec", "nz", "norm_sq")])
    b = vecs.select("model_name", "conv_id", (F.col("turn") - 1).alias("turn"),
                    *[F.col(c).alias("b_" + c) for c in ("vec", "nz", "norm_sq")])
    j = pairs.join(a, ["conv_id", "turn"]).join(b, ["model_name", "conv_id", "turn"])
    return j.select("model_name", "conv_id", "turn", "human_score",
                    V.cosine_between("a_", "b_").alias("similarity"),
                    F.col("dim").alias("embedding_dimension"),
                    *[F.try_element_at(f"{side}_vec", F.lit(i + 1)).cast("double").alias(f"{name}_{i}")
                      for side, name in (("a", "e1"), ("b", "e2")) for i in range(5)])


def correlations(sims: DataFrame, buckets: int | None = None) -> DataFrame:
    """Pearson and Spearman of human score vs similarity per model (pairs
    with an undefined score or similarity are left out)."""
    d = sims.filter(F.col("similarity").isNotNull() & F.col("human_score").isNotNull())
    p = X.pearson(d, ["model_name"], "human_score", "similarity")
    s = X.spearman(d, ["model_name"], "human_score", "similarity", buckets=buckets).drop("n")
    return p.join(s, "model_name")


def comparison_display(table: DataFrame, timing: DataFrame | None = None) -> DataFrame:
    """The rows of a comparison (``model_order, model_name``, both correlations, ``embedding_dimension``) as text.

    ``timing`` (``embed.embedding_timing``) has the load time and the mean embedding
    time of models that were measured; others show NULL.
    """
    if timing is None:
        table = table.withColumns({c: F.lit(None).cast("double") for c in SECONDS})
    else:
        table = table.join(timing.select("model_name", *SECONDS), "model_name", "left")
    return table.select(
        "model_order", "model_name",
        *[D.to_fixed(F.col(c), L.SCORE_DIGITS).alias(c) for c in ("pearson_correlation", "spearman_correlation")],
        "embedding_dimension", D.to_fixed(F.col("load_time_seconds"), L.TIME_DIGITS).alias("load_time_seconds"),
        D.to_fixed(F.col("average_embedding_time_seconds"), L.SCORE_DIGITS).alias("average_embedding_time_seconds"))
