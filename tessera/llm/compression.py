"""Compression models: one zstandard raw-content dictionary for each label.

A text is cut into segments, each segment is compressed with each label's
dictionary, and the label whose total is smallest explains the text best.
Segments keep the dictionary in play over the whole of a long text, where a
single frame would soon learn from the text itself and forget the labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 4096
LEVEL = 6


def first_by_hash(rows: DataFrame, label: str, key: str, most: int, seed: int) -> DataFrame:
    """The ``most`` rows of each label that come first by a hash of ``key``; columns ``label``, ``pick`` and the others.

    Labels are counted first, and only rows whose hash lies in the part of its
    range where about four times as many are expected are sorted at all.
    Rows with a null label are left out.
    """
    rows = rows.withColumn("label", F.col(label).cast("string")).where(F.col("label").isNotNull())
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    limit = F.lit(None).cast("long")
    for value, n in counts.items():
        part = min(1.0, 4 * most / n)
        limit = F.when(F.col("label") == value, F.lit(min(int(part * 2 ** 64) - 2 ** 63, 2 ** 63 - 1))).otherwise(limit)
    order = Window.partitionBy("label").orderBy("pick", key)
    return (rows.withColumn("pick", F.xxhash64(F.col(key).cast("string"), F.lit(seed))).where(F.col("pick") <= limit)
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank"))


def learn_dictionaries(labelled: DataFrame, label: str, text: str, key: str, dict_bytes: int = 112 * 1024,
                       sample_docs: int = 400, slice_chars: int = 400) -> dict[str, bytes]:
    """``{label: dictionary}`` from a bounded sample of labelled rows.

    The sample is one slice of ``slice_chars`` characters, at a place that a
    hash chooses, from each of the ``sample_docs`` rows of each label that come
    first by a hash of ``key``.  Equal slices count once, and a dictionary has
    at most ``dict_bytes`` bytes.  Many short slices show a model more kinds of
    text than a few whole documents would.  Rows with a null label or an empty
    text teach nothing.  The driver gets ``sample_docs`` slices a label.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.octet_length(text), F.lit(18)),
                   F.greatest(F.length(text) - slice_chars, F.lit(0)) + 1) + 1
    slices = (labelled.where(F.length(text) > 0)
              .select(F.col(label), F.col(key), F.substring(F.col(text), place.cast("int"), F.lit(slice_chars)).alias("body")))
    rows = first_by_hash(slices, label, key, sample_docs, 17).select("label", "pick", "body").collect()
    bodies: dict[str, dict[bytes, None]] = {}
    for row in sorted(rows, key=lambda r: (r["label"], r["pick"], r["body"])):
        bodies.setdefault(row["label"], {})[row["body"].encode()] = None
    return {k: b"\n".join(v)[:dict_bytes] for k, v in sorted(bodies.items())}


def values(batch: pa.Array, most: int = 256) -> Iterator:
    """The Python values of a batch, a few at a time, so that its texts are not held twice."""
    for start in range(0, len(batch), most):
        yield from batch.slice(start, most).to_pylist()


class Compressors:
    """Compressed sizes of a text under each dictionary; one object for each Python worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, segment: int = SEGMENT):
        self.labels = list(dictionaries)
        self.segment = segment
        self._all = []
        for content in dictionaries.values():
            # zstandard needs eight bytes of content at least
            trained = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(level=level)
            self._all.append(zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=False,
                                                      write_content_size=False, write_dict_id=False))

    def sizes(self, data: bytes) -> np.ndarray:
        """Bytes of ``data`` under each dictionary, in the order of ``labels``."""
        step = self.segment
        parts = [data[i:i + step] for i in range(0, len(data), step)] if len(data) > step else [data]
        return np.array([sum(len(c.compress(p)) for p in parts) for c in self._all], dtype=np.int64)


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it one that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
