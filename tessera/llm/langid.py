"""Language identification by compression.

Each language has a zstandard raw-content dictionary made from texts in it;
a text has the language whose dictionary compresses it best.  The answer is
marked as rejected when the runner-up is nearly as good.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.compression import Compressors, free_name, learn_dictionaries, remainder, values

UNDETERMINED = "und"
SEGMENT = 4096
#: Letters stay; every other ASCII character becomes a space.
LETTERS = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
RESULT = "struct<lang_pred: string, score: double, margin: double>"


def letters(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(LETTERS)


def learn_languages(docs: DataFrame, dict_bytes: int = 112 * 1024, sample_docs: int = 400) -> dict[str, bytes]:
    """Dictionaries from ``text`` and ``lang`` of ``docs`` (see :func:`learn_dictionaries` for the bounds)."""
    bodies = learn_dictionaries(docs, "lang", "text", "doc_id", dict_bytes, sample_docs)
    return {k: letters(v.decode("utf-8", "ignore")) for k, v in bodies.items()}


def language_of(text: Column, dictionaries: dict[str, bytes], spark: SparkSession) -> Column:
    """Struct of the language, the confidence in it (0 to 1) and its lead over the runner-up.

    ``margin`` is (runner-up - best) / runner-up in compressed bytes.  A text
    that is null or has no letter, or any text if no language was learned, is
    ``und`` with score and margin 0.  Ties go to the label that sorts first.
    """
    sent = spark.sparkContext.broadcast(dictionaries)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Compressors(sent.value, segment=SEGMENT)
        names = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64())])
        for batch in batches:
            yield pa.array([_predict(model, t) for t in values(batch)], type=names)

    return F.arrow_udf(predict, RESULT)(text)


def _predict(model: Compressors, text: str | None) -> tuple[str, float, float]:
    if not text or not model.labels or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, 0.0
    sizes = model.sizes(letters(text))
    best = int(sizes.argmin())
    others = [int(s) for i, s in enumerate(sizes) if i != best]
    if not others:
        return model.labels[best], 1.0, 1.0
    lead = int(sizes[best])
    score = 1 / (1 + sum(math.exp(-min(s - lead, 700) / 4) for s in others))
    return model.labels[best], score, (min(others) - lead) / max(min(others), 1)


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.01) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``margin`` and ``rejected``.

    ``rejected`` marks answers whose margin is under ``min_margin``, ``und``
    among them.  Columns of those names are replaced; all others pass through.
    Every row is kept, repeated rows too.
    """
    own = free_name(docs, "_lang")
    out = docs.withColumn(own, language_of(F.col("text"), dictionaries, docs.sparkSession))
    for name in ("lang_pred", "score", "margin"):
        out = out.withColumn(name, F.col(f"{own}.{name}"))
    return out.withColumn("rejected", F.col("margin") < min_margin).drop(own)


def held_out_languages(docs: DataFrame) -> DataFrame:
    """The query: learn from rows whose crc32(doc_id) mod 4 is not 2, predict all."""
    marked = docs.withColumn("held_out", remainder("doc_id", 4) == 2)
    model = learn_languages(marked.where(~F.col("held_out")))
    return identify_language(marked, model).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")
