"""Paragraph coherence: similarity of each paragraph to the previous one.

Order inside a document is ``(major, minor)``.  A ``lag`` over
``partitionBy(model, doc)`` would put a whole document in one task, and one
document may hold a third of the corpus.  So the vectors are range-partitioned
on ``(model, doc, major, minor)`` -- one shuffle, balanced by Spark's sampling
whatever the order keys are -- and one sorted pass compares neighbours.  It
also gives each range's first and last vector, a row each, with which the
pairs across range borders are completed.  Coherence crosses section
boundaries, like the evaluated toolkit.  Units of native models are dealt out as
texts, a tenth of their vectors, and embedded in that pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import materialise

#: What a row of the pass is about; a timed one has the number of units of a document and the seconds that they took.
PAIR, FIRST, LAST, TIMED = 0, 1, 2, 3
NEIGHBOURS = ("range int, kind int, major long, minor long, prev_major long, prev_minor long, similarity double, "
              "vec array<float>, norm_sq double")


def _similarities(batch: pa.RecordBatch) -> np.ndarray:
    """Cosine of each row's vector with the row before; NaN where one is zero or missing, or sizes differ."""
    n = batch.num_rows
    out = np.full(n, np.nan)
    column = batch.column("vec")
    norms = batch.column("norm_sq").fill_null(0.0).to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    # runs of vectors of one size are one matrix
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        if sizes[a] and b - a > 1:
            rows = flat[starts[a]:starts[a] + sizes[a] * (b - a)].reshape(b - a, -1)
            norm = norms[a + 1:b] * norms[a:b - 1]
            dots = np.einsum("ij,ij->i", rows[1:], rows[:-1])
            np.divide(dots, np.sqrt(norm), out=out[a + 1:b], where=norm > 0)
    return out


class _Pass:
    """Sorted rows of a range, batch by batch -> a row for each neighbouring pair, and the range's first and last row."""

    def __init__(self, keys: list[str], number: int):
        self.keys, self.number, self.before = keys, number, None

    def _rows(self, batch: pa.RecordBatch, kind: int, previous: pa.RecordBatch | None, similarity) -> pa.RecordBatch:
        n = batch.num_rows
        nothing = pa.nulls(n, pa.int64())
        whole = kind in (FIRST, LAST)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in self.keys), pa.array([self.number] * n, pa.int32()), pa.array([kind] * n, pa.int32()),
             batch.column("major"), batch.column("minor"),
             previous.column("major") if previous is not None else nothing,
             previous.column("minor") if previous is not None else nothing,
             pa.array(similarity, pa.float64(), from_pandas=True) if similarity is not None
             else pa.nulls(n, pa.float64()),
             batch.column("vec") if whole else pa.nulls(n, batch.schema.field("vec").type),
             batch.column("norm_sq") if whole else pa.nulls(n, pa.float64())],
            names=[*self.keys, "range", "kind", "major", "minor", "prev_major", "prev_minor", "similarity", "vec", "norm_sq"])

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.before is None:
            yield self._rows(batch.slice(0, 1), FIRST, None, None)
            joined = batch
        else:
            joined = pa.Table.from_batches([self.before, batch]).combine_chunks().to_batches()[0]
        last = batch.slice(batch.num_rows - 1)
        self.before = last.take(pa.array([0]))   # a copy, so that the batch can go
        same = np.ones(joined.num_rows - 1, dtype=bool)
        for k in self.keys:
            values = joined.column(k).to_numpy(zero_copy_only=False)
            same &= values[1:] == values[:-1]
        own = np.flatnonzero(same)
        if len(own):
            yield self._rows(joined.take(pa.array(own + 1)), PAIR, joined.take(pa.array(own)), _similarities(joined)[own + 1])

    def spent(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Units and seconds of each document in a batch of timed rows."""
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = False
        for k in self.keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        seconds = np.add.reduceat(batch.column("elapsed_s").to_numpy(), starts)
        rows = self._rows(batch.take(pa.array(starts)), TIMED, None, seconds)
        units = pa.array(np.diff([*starts, batch.num_rows]), pa.int64())
        return rows.set_column(rows.schema.get_field_index("prev_major"), "prev_major", units)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.before is not None:
            yield self._rows(self.before, LAST, None, None)


def _neighbours(keys: list[str], embedding: Callable | None = None):
    """:class:`_Pass` over sorted vectors; with an ``embedding`` over sorted units, a pass for each of its models."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        passes: dict[str | None, _Pass] = {}
        columns = [*keys, "major", "minor", "vec", "norm_sq"]
        for batch in embedding(batches) if embedding else batches:
            if batch.num_rows:
                model = batch.column("model_name")[0].as_py() if embedding else None
                one = passes.setdefault(model, _Pass(keys, number))
                if "elapsed_s" in batch.schema.names:
                    yield one.spent(batch)
                yield from one.feed(batch.select(columns))
        for one in passes.values():
            yield from one.end()
    return run


def adjacent_similarity(vecs: DataFrame, keys: tuple[str, ...] = ("model_name", "doc"),
                        ranges: int | None = None, native: Callable | None = None) -> DataFrame:
    """Rows ``keys, major, minor, prev_major, prev_minor, similarity`` for every
    unit that has a predecessor.  ``similarity`` is NULL for a zero vector.

    ``ranges`` defaults to ``spark.sql.shuffle.partitions``.  The result of the
    pass, without the vectors, is written and read back.

    With ``native`` (``embed.native_pass`` of some models) ``vecs`` are units with
    their ``text``: these are dealt out and sorted, and become vectors in the pass itself.
    """
    return neighbouring(neighbour_pass(vecs, keys, ranges, native), keys)


def neighbour_pass(vecs: DataFrame, keys: tuple[str, ...] = ("model_name", "doc"), ranges: int | None = None,
                   native: Callable | None = None) -> DataFrame:
    """The written result of the pass for :func:`neighbouring` and, where ``native`` is timed, :func:`embedding_times`."""
    keys = list(keys)
    spark = vecs.sparkSession
    order = [*keys, "major", "minor"]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if native is None:
        typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vecs.select(*keys).schema.fields)
        dealt, embedding = vecs.select(*order, "vec", "norm_sq").repartitionByRange(n, *order).sortWithinPartitions(*order), None
    else:
        own = [c for c in order if c != "model_name"]
        typed = ", ".join("model_name string" if k == "model_name" else f"`{k}` {vecs.schema[k].dataType.simpleString()}"
                          for k in keys)
        dealt, embedding = native(vecs.select(*own, "text").repartitionByRange(n, *own).sortWithinPartitions(*own))
    return materialise(dealt.mapInArrow(_neighbours(keys, embedding), f"{typed}, {NEIGHBOURS}"), "adjacent")


def embedding_times(found: DataFrame, keys: tuple[str, ...] = ("model_name", "doc")) -> DataFrame:
    """``keys, n, s``: units that a timed pass embedded, and the seconds that they took."""
    return found.where(F.col("kind") == TIMED).groupBy(*keys).agg(
        F.sum("prev_major").alias("n"), F.sum("similarity").alias("s"))


def neighbouring(found: DataFrame, keys: tuple[str, ...] = ("model_name", "doc")) -> DataFrame:
    """The pairs of a :func:`neighbour_pass`, also those across the borders of its ranges."""
    order = [*keys, "major", "minor"]
    # across borders: the last row of the nearest range before that ends in the same document
    earlier = Window.partitionBy(*keys).orderBy("range").rangeBetween(Window.unboundedPreceding, -1)
    last = F.when(F.col("kind") == LAST, F.struct("major", "minor", "vec", "norm_sq"))
    edges = (found.where(F.col("kind").isin(FIRST, LAST))
             .withColumn("p", F.last(last, ignorenulls=True).over(earlier))
             .where((F.col("kind") == FIRST) & F.col("p").isNotNull()))
    columns = [*order, "prev_major", "prev_minor", "similarity"]
    across = edges.select(*order, F.col("p.major").alias("prev_major"), F.col("p.minor").alias("prev_minor"),
                          V.cosine(F.col("vec"), F.col("p.vec"), F.col("norm_sq"), F.col("p.norm_sq")).alias("similarity"))
    return found.where(F.col("kind") == PAIR).select(*columns).unionByName(across)


def paragraph_coherence(adjacent: DataFrame, keys: tuple[str, ...] = ("model_name", "doc")) -> DataFrame:
    """avg / min / max / population std of adjacent similarities per document.

    A document with fewer than two paragraphs has no adjacent pair and gets no
    row (the evaluated toolkit fails on the empty list and drops the model).
    Undefined similarities (zero vectors) are excluded and counted.
    """
    s = F.col("similarity")
    return adjacent.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_adjacent_pairs"),
        F.count_if(s.isNull()).alias("n_undefined"),
        F.avg(s).alias("avg_coherence"),
        F.min(s).alias("min_coherence"),
        F.max(s).alias("max_coherence"),
        F.stddev_pop(s).alias("coherence_std"))
