"""Quality scores by compression.

Two zstandard raw-content dictionaries, from texts labelled good and bad,
compress a text in short segments.  The difference of the two sizes for each
byte of text, put through a logistic curve fitted on other labelled texts, is
the probability that the text is good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.compression import Compressors, first_by_hash, free_name, learn_dictionaries, remainder, values
from tessera.session import materialise

#: Short segments keep a text's own repetitions from hiding what it shares with a dictionary.
SEGMENT = 128
REJECT_BELOW = 0.3


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries of the labels "0" (bad) and "1" (good) and the fitted curve."""

    dictionaries: dict[str, bytes]
    slope: float
    intercept: float


def size_difference(text: Column, dictionaries: dict[str, bytes], spark: SparkSession) -> Column:
    """(size under bad - size under good) / bytes; 0 for null and empty texts or where a label is missing."""
    sent = spark.sparkContext.broadcast(dictionaries)

    def difference(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Compressors(sent.value, segment=SEGMENT)
        both = [model.labels.index(x) for x in ("0", "1") if x in model.labels]
        for batch in batches:
            out = np.zeros(len(batch))
            if len(both) == 2:
                for i, data in enumerate(values(batch.cast(pa.binary()))):
                    if data:
                        bad, good = model.sizes(data)[both]
                        out[i] = (bad - good) / len(data)
            yield pa.array(out)

    return F.arrow_udf(difference, "double")(text)


def learn_quality(docs: DataFrame, labels: DataFrame, dict_bytes: int = 112 * 1024, sample_docs: int = 400,
                  calibration_docs: int = 4000) -> QualityModel:
    """Fit on ``docs`` joined with ``labels`` (doc_id, quality).

    One half of the labelled rows, by a hash of doc_id, fills the dictionaries
    (bounds: :func:`learn_dictionaries`); ``calibration_docs`` rows of the other
    half, first by a hash, fit the curve.  Rows without a label of 0 or 1 are
    not used; a doc_id labelled twice with different values is used with each,
    and of rows that repeat a doc_id the least text.
    The driver gets the ids of the chosen rows and their size differences.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("_y")).distinct()
    # rows are chosen by their ids; only the texts of the chosen ones move
    ids = (docs.select("doc_id").join(known, "doc_id")
           .withColumn("_half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2))))
    shown = first_by_hash(ids.where("_half = 0"), "_y", "doc_id", sample_docs, 17).select("doc_id", "_y", "_half")
    fitted = first_by_hash(ids.where("_half = 1").withColumn("_all", F.lit("all")), "_all", "doc_id", calibration_docs, 6)
    chosen = shown.unionByName(fitted.select("doc_id", "_y", "_half")).distinct().collect()
    chosen = spark.createDataFrame(chosen, "doc_id long, _y int, _half long")
    # of rows that repeat a chosen doc_id one text, so that the sample keeps its bound
    rows = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
                       .groupBy("doc_id", "_y", "_half").agg(F.min("text").alias("text")), "quality-sample")
    dictionaries = learn_dictionaries(rows.where("_half = 0"), "_y", "text", "doc_id", dict_bytes, sample_docs)
    fitted = (rows.where("_half = 1").select(size_difference(F.col("text"), dictionaries, spark).alias("x"), "_y")
              .collect())
    slope, intercept = fit_logistic(np.array([r["x"] for r in fitted]), np.array([r["_y"] for r in fitted], dtype=float))
    return QualityModel(dictionaries, slope, intercept)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of P(y = 1 | x) by Newton's method; the ridge keeps separable data finite."""
    if not len(x):
        return 0.0, 0.0
    rows = np.column_stack([x * 100, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -35, 35)))
        gradient = rows.T @ (p - y) + ridge * w
        hessian = (rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]) * 100, 0.0), float(w[1])


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier good) and ``predicted`` (1 from 0.3 on).

    Null and empty texts score as a text that tells nothing.  Columns of those
    names are replaced; all others pass through.  Every row is kept.
    """
    x = size_difference(F.col("text"), model.dictionaries, docs.sparkSession)
    own = free_name(docs, "_x")
    score = 1 / (1 + F.exp(-(F.col(own) * model.slope + model.intercept)))
    return (docs.withColumn(own, x).withColumn("score", score)
            .withColumn("predicted", (F.col("score") >= REJECT_BELOW).cast("int")).drop(own))


def held_out_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query: learn from rows whose crc32(doc_id) mod 5 is not 0, score all."""
    marked = docs.withColumn("held_out", remainder("doc_id", 5) == 0)
    model = learn_quality(marked.where(~F.col("held_out")), labels)
    return score_quality(marked, model).select("doc_id", "held_out", "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, learned from all labels, with the columns that they have.

    Repeated rows are judged alike; null and empty texts get the score of a
    text that tells nothing.  Without labels of both kinds every text has the
    share of good labels as its score, 0.5 if there is none, and none or all go.
    """
    model = learn_quality(docs, labels)
    predicted = score_quality(docs.select(F.struct("*").alias("record"), "text"), model)
    return predicted.where("predicted = 1").select("record.*")
