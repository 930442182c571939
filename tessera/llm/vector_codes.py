"""Vector codes by active-entry Lloyd rounds in whole numbers.

Vectors become integers and are cut into parts; each part position has a
codebook.  A row carries, from round to round, the entry that each part is
assigned to and the exact distance to it.  After an update, a part whose entry
stayed where it was compares that distance with the entries that moved only;
every other part scans the whole codebook again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import drop_scratch, scratch_path

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Greatest component as an integer; distances of wider ones might not fit in 64 bits.
WIDEST = 1 << 28
#: Rows whose distances to a codebook are held at a time.
PORTION = 2048


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, cells``: components x as floor(SCALE * x); rows without a finite vector are dropped."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cells = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return vectors.where(F.col("embedding").isNotNull() & finite).select("vec_id", "label", cells.alias("cells"))


def nearest(cells: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``cells`` the least squared distance to ``book`` and its first entry."""
    best, at = np.empty(len(cells), dtype=np.int64), np.empty(len(cells), dtype=np.int64)
    for low in range(0, len(cells), PORTION):
        part = slice(low, low + PORTION)
        distance = np.zeros((len(cells[part]), len(book)), dtype=np.int64)
        for component in range(book.shape[1]):
            apart = cells[part, component, None] - book[:, component]
            distance += apart * apart
        at[part] = distance.argmin(axis=1)
        best[part] = distance[np.arange(len(distance)), at[part]]
    return best, at


def reassign(cells: np.ndarray, books: np.ndarray, moved: np.ndarray, codes: np.ndarray,
             distances: np.ndarray) -> int:
    """Assigns every part anew, in place, and returns how many parts were scanned completely.

    ``cells``: row, part, component; ``books``: part, entry, component;
    ``moved``: part, entry; ``codes`` and ``distances``: row, part, as they
    were before the entries moved.  Ties go to the lower entry.
    """
    rescanned = 0
    for p in range(books.shape[0]):
        again = moved[p][codes[:, p]]
        rescanned += int(again.sum())
        if again.any():
            distances[again, p], codes[again, p] = nearest(cells[again, p], books[p])
        entries, fixed = np.flatnonzero(moved[p]), np.flatnonzero(~again)
        if len(entries) and len(fixed):
            distance, at = nearest(cells[fixed, p], books[p, entries])
            entry, own = entries[at], distances[fixed, p]
            better = (distance < own) | ((distance == own) & (entry < codes[fixed, p]))
            distances[fixed[better], p], codes[fixed[better], p] = distance[better], entry[better]
    return rescanned


STATE_COLUMNS = ("vec_id {id}, label {label}, cells array<int>, codes array<int>, distances array<long>, "
                 "tally array<long>")


def lloyd_pass(rows: DataFrame, books: np.ndarray, moved: np.ndarray, path: str) -> DataFrame:
    """Assigns all ``rows`` and writes them to ``path`` with their state; returns the table.

    A row with a ``tally`` in place of a vector closes each task: for each part
    and entry the sum of its parts' components, then the number of parts of each.
    """
    parts, entries, width = books.shape
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    started = "codes" in kinds
    columns = ["vec_id", "label", "cells"] + (["codes", "distances"] if started else [])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width), dtype=np.int64)
        sizes = np.zeros((parts, entries), dtype=np.int64)
        kind = None
        for batch in batches:
            n = batch.num_rows
            given = batch.column(2).flatten().to_numpy().reshape(n, -1)
            cells = np.zeros((n, parts * width), dtype=np.int64)
            cells[:, :given.shape[1]] = given
            cells = cells.reshape(n, parts, width)
            codes, distances = (batch.column(i).flatten().to_numpy().reshape(n, parts).astype(np.int64) if started
                                else np.zeros((n, parts), dtype=np.int64) for i in (3, 4))
            reassign(cells, books, moved, codes, distances)
            for p in range(parts):
                sizes[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(sums[p], codes[:, p], cells[:, p])
            kind = (batch.column(0).type, batch.column(1).type)
            yield _state(batch.column(0), batch.column(1), _lists(cells, pa.int32()), _lists(codes, pa.int32()),
                         _lists(distances, pa.int64()), pa.nulls(n, pa.list_(pa.int64())))
        if kind:
            tally = np.concatenate([sums.ravel(), sizes.ravel()])
            yield _state(*(pa.nulls(1, k) for k in (*kind, *map(pa.list_, (pa.int32(), pa.int32(), pa.int64())))),
                         _lists(tally[None], pa.int64()))

    state = rows.select(columns).mapInArrow(assign, STATE_COLUMNS.format(id=kinds["vec_id"], label=kinds["label"]))
    state.write.parquet(path)
    return rows.sparkSession.read.schema(state.schema).parquet(path)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list for each row of an array."""
    size = rows.size // max(len(rows), 1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size, pa.int32()),
                                    pa.array(rows.ravel()).cast(kind))


def _state(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["vec_id", "label", "cells", "codes", "distances", "tally"])


def moved_entries(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after an update: componentwise floor(sum / count); unused entries stay."""
    total = (state.where("tally is not null").select(F.posexplode("tally").alias("at", "n"))
             .groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect())
    flat = {r["at"]: int(r["n"]) for r in total}  # parts x entries x (components + 1) numbers
    if not flat:
        return books
    out = books.copy()
    parts, entries, width = books.shape
    for at in np.ndindex(parts, entries):
        number = at[0] * entries + at[1]
        if size := flat[parts * entries * width + number]:
            out[at] = [flat[number * width + i] // size for i in range(width)]
    return out


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
                     rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, codes, error`` of the vectors that are kept, and the final codebooks (part, entry, component).

    ``codes``: an array of a number for each part; ``error``: the squared
    distances to the entries, added up.  Each codebook starts as that part of the
    ``entries`` smallest vec_ids (null after all others, equal ones by their
    components), fewer if there are fewer rows.  Rows whose vector is null or
    has null or non-finite components are dropped, also those of another length
    than the first vector's; a length that ``parts`` does not divide is filled up with
    zeros, and an empty vector has errors of 0.  Repeated rows count each; an
    empty table gives no rows; other columns are not read.  Components from
    ``WIDEST / SCALE`` on are an error, since ``error`` might not fit in a long.

    Each round reads and writes the rows once, without a shuffle; what reaches
    the driver is a codebook.  A round's table is deleted when the next is written.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "cells").limit(entries).collect()
    length = len(first[0]["cells"]) if first else 0
    rows = rows.where(F.size("cells") == length)
    widest = rows.select(F.max(F.greatest(F.abs(F.array_max("cells")), F.abs(F.array_min("cells"))))).first()[0]
    if (widest or 0) >= WIDEST:
        raise ValueError(f"components of {WIDEST // SCALE} and more")
    width = -(-length // parts)
    start = [r["cells"] + [0] * (parts * width - length) for r in first if len(r["cells"]) == length]
    books = np.array(start, dtype=np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    moved = np.ones(books.shape[:2], dtype=bool)
    state, old = rows, None
    for number in range(rounds + 1):
        path = scratch_path(spark, f"vector-codes-{number}")
        table = lloyd_pass(state, books, moved, path)
        if old:
            drop_scratch(old)
        old, state = path, table.where("tally is null").drop("tally")
        if number < rounds:
            after = moved_entries(table, books)
            moved = (after != books).any(axis=2)
            if not moved.any():
                break  # every later round would find the same
            books = after
    return state.select("vec_id", "label", "codes",
                        F.aggregate("distances", F.lit(0).cast("long"), lambda a, d: a + d).alias("error")), books


def codebook_text(books: np.ndarray) -> str:
    """All components by part, entry and position within the part, with commas between them."""
    return ",".join(map(str, books.ravel().tolist()))


def vector_code_report(vectors: DataFrame) -> DataFrame:
    """The query: each kept vector's code in hex, its error, its label's error and the codebooks' digest.

    Vectors with a null label are a label of their own.  Errors are added up by label before they meet the rows, so
    that no label's rows go to one task.
    """
    coded, books = compress_vectors(vectors)
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    code = F.lower(F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0"))))
    digest = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    return (coded.join(labels, F.col("label").eqNullSafe(F.col("of_label")))
            .select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def vector_code_sql(dim: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of :func:`vector_code_report`: every round a full scan of all entries."""
    width = dim // parts
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS cells FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, p, list_slice(cells, p * {width} + 1, p * {width} + {width}) AS part
    FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (SELECT p, row AS entry, part AS centre FROM parts WHERE row < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT row, p, any_value(part) AS part, min(d) AS d,
    arg_min(entry, d * {entries} + entry) AS entry FROM (SELECT row, p, part, entry,
        list_sum(list_transform(list_zip(part, centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts JOIN book{r} USING (p)) GROUP BY row, p)""")
        if r < rounds:
            steps.append(f"""sums{r} AS (SELECT p, entry, i, sum(part[i])::BIGINT AS s, count(*) AS n
    FROM near{r}, range(1, {width + 1}) t(i) GROUP BY p, entry, i),
means{r} AS (SELECT p, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS centre FROM sums{r} GROUP BY p, entry),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(m.centre, b.centre) AS centre
    FROM book{r} b LEFT JOIN means{r} m ON m.p = b.p AND m.entry = b.entry)""")
    return "WITH " + ",\n".join(steps) + f""",
coded AS (SELECT row, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
    FROM near{rounds} GROUP BY row),
books AS (SELECT sha256(string_agg(array_to_string(centre, ','), ',' ORDER BY p, entry)) AS codebooks_sha256
          FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (row) CROSS JOIN books"""
