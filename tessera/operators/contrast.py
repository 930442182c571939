"""Section contrast: mean similarity of paragraph pairs inside a section minus
the mean over pairs from different sections (population stds too).

All unordered pairs ``i < j`` of a document are needed, which is O(n^2) for
one document.  The statistics only need, per group, the number of pairs, the
sum of similarities and the sum of squared similarities, and those have an
exact O(n d^2) form for unit vectors ``u``:

* ``sum_{i<j} u_i.u_j       = (|sum u|^2 - sum |u|^2) / 2``
* ``sum_{i<j} (u_i.u_j)^2   = (|sum u u^T|_F^2 - sum |u|^4) / 2``

One exchange brings the rows of a group together, sorted by section, and one
pass goes over them.  A document of at most ``small_max`` vectors is scored with
one ``U U^T`` (bounded: at most ``small_max^2/2`` pairs, never materialised as
rows), as is each section of at most that many; larger ones add up ``sum u`` and
``sum u u^T`` batch by batch, so that no group is ever held by a task.  A document of more than
``rows_per_partial`` vectors is dealt out by its sections in parts of about that many rows, and a section of more
than that by chunks of as many.  Each task gives one Gram matrix
of what it has of such a group, in pieces, which are added piece by piece.
Cross-section numbers are ``document - within-section``; where a document has
few cross pairs among very many, that difference has fewer exact digits.

Numbers of pairs are exact: ``decimal(38,0)`` holds those of 1e19 vectors.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: What a row of the pass is about: a finished part of a document, or a piece of the sums of a dealt-out document or section.
DONE, OF_DOCUMENT, OF_SECTION = 0, 1, 2
PARTS = ("section string, kind int, n_units long, n_zero_vectors long, t_n long, t_s1 double, t_s2 double, w_n_pairs long, "
         "w_s1 double, w_s2 double, n long, t double, q double, piece int, cells array<double>")
#: Cells of a Gram matrix in one row.
PIECE = 1024


class _Moments:
    """``n``, ``sum |u|^2``, ``sum |u|^4``, ``sum u`` and ``sum u u^T`` of unit vectors.  Few rows wait until there are as
    many as components: a step goes over the whole matrix."""

    def __init__(self, d: int):
        self.n, self.t, self.q, self.s, self.g = 0, 0.0, 0.0, np.zeros(d), np.zeros((d, d))
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, mat: np.ndarray) -> None:
        self.n += len(mat)
        self.waiting.append(mat)
        self.held += len(mat)
        if self.held >= len(self.s):
            self._step()

    def _step(self) -> None:
        if self.held:
            mat = self.waiting[0] if len(self.waiting) == 1 else np.vstack(self.waiting)
            self.waiting, self.held = [], 0
            squares = np.einsum("ij,ij->i", mat, mat)
            self.t += float(squares.sum())
            self.q += float((squares * squares).sum())
            self.s += mat.sum(axis=0)
            self.g += mat.T @ mat

    def sums(self) -> tuple[float, float]:
        self._step()
        return (float(self.s @ self.s) - self.t) / 2, (float((self.g * self.g).sum()) - self.q) / 2

    def pieces(self) -> list[tuple[int, np.ndarray]]:
        """``sum u`` as piece 0, the upper triangle of ``sum u u^T`` with off-diagonal cells scaled by sqrt 2 as the others."""
        self._step()
        iu = np.triu_indices(len(self.s))
        cells = self.g[iu] * np.where(iu[0] == iu[1], 1.0, np.sqrt(2.0))
        cut = [(1 + i // PIECE, cells[i:i + PIECE]) for i in range(0, len(cells), PIECE)]
        return [(0, self.s)] + [(i, c) for i, c in cut if c.any()]


@functools.lru_cache(maxsize=64)
def _few_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, k=1)


def _pairs(mat: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    iu = _few_pairs(len(mat)) if len(mat) <= 64 else np.triu_indices(len(mat), k=1)
    return (mat @ mat.T)[iu], iu


class _Document:
    """The rows that a task has of one document, by section."""

    def __init__(self, dealt: bool, small_max: int):
        self.small_max, self.dealt = small_max, dealt
        self.n_units = self.n_zero = 0
        self.rows: list[tuple] = []       # while few: (section, dealt section, unit vectors)
        self.held = 0
        self.whole: _Moments | None = None
        self.section, self.own, self.moments, self.dealt_section = None, [], None, False
        self.within = [0, 0.0, 0.0]
        self.pieces: list[tuple] = []     # (kind, section, moments)

    def add(self, section, dealt_section: bool, mat: np.ndarray) -> None:
        if self.whole is None:
            self.rows.append((section, dealt_section, mat))
            self.held += len(mat)
            if self.held <= self.small_max and not self.dealt:
                return
            self.whole = _Moments(mat.shape[1])
            for row in self.rows:
                self._large(*row)
            self.rows = []
        else:
            self._large(section, dealt_section, mat)

    def _large(self, section, dealt_section: bool, mat: np.ndarray) -> None:
        self.whole.add(mat)
        if section != self.section:
            self._end_section()
            self.section, self.dealt_section = section, dealt_section
        if section is None:     # belongs to no section
            return
        if self.moments is None:
            self.own.append(mat)
            if sum(map(len, self.own)) > self.small_max or dealt_section:
                self.moments = _Moments(mat.shape[1])
                for m in self.own:
                    self.moments.add(m)
                self.own = []
        else:
            self.moments.add(mat)

    def _end_section(self) -> None:
        if self.moments is not None and self.dealt_section:
            self.pieces.append((OF_SECTION, self.section, self.moments))
        elif self.moments is not None:
            n = self.moments.n
            self._within(n * (n - 1) // 2, *self.moments.sums())
        elif sum(map(len, self.own)) > 1:
            sims, _ = _pairs(np.vstack(self.own))
            self._within(len(sims), float(sims.sum()), float((sims * sims).sum()))
        self.own, self.moments = [], None

    def _within(self, n: int, s1: float, s2: float) -> None:
        self.within = [self.within[0] + n, self.within[1] + s1, self.within[2] + s2]

    def end(self) -> tuple[int, float, float]:
        """Number of vectors and sums over the pairs of the document, where they are final here."""
        if self.whole is None:
            if self.held < 2:
                return self.held, 0.0, 0.0
            sims, (i, j) = _pairs(np.vstack([m for _, _, m in self.rows]))
            names: dict = {}
            sec = np.repeat([names.setdefault(s, len(names)) for s, _, _ in self.rows], [len(m) for _, _, m in self.rows])
            w = sims[sec[i] == sec[j]]
            self._within(len(w), float(w.sum()), float((w * w).sum()))
            return self.held, float(sims.sum()), float((sims * sims).sum())
        self._end_section()
        if self.dealt:
            self.pieces.append((OF_DOCUMENT, None, self.whole))
            return 0, 0.0, 0.0
        return self.whole.n, *self.whole.sums()


def _parts(keys: list[str], small_max: int, embedding: Callable | None):
    """Rows sorted by ``keys`` and section -> finished parts and pieces; with an ``embedding`` the rows are units of
    all its models."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str | None, tuple[tuple, _Document]] = {}
        schema = None

        def rows_of(done: list[tuple[tuple, _Document]]) -> Iterator[pa.RecordBatch]:
            out = {name: [] for name in [*keys, *(c.split()[0] for c in PARTS.split(", "))]}

            def put(key, **values):
                for k, v in zip(keys, key):
                    out[k].append(v)
                for name in list(out)[len(keys):]:
                    out[name].append(values.get(name))

            for key, doc in done:
                n, s1, s2 = doc.end()
                put(key, kind=DONE, n_units=doc.n_units, n_zero_vectors=doc.n_zero, t_n=n, t_s1=s1, t_s2=s2,
                    w_n_pairs=doc.within[0], w_s1=doc.within[1], w_s2=doc.within[2])
                for kind, section, m in doc.pieces:
                    for piece, cells in m.pieces():
                        first = {"n": m.n, "t": m.t, "q": m.q} if piece == 0 else {}
                        put(key, kind=kind, section=section, piece=piece, cells=cells, **first)
            types = [schema.field(k).type for k in keys] + [
                pa.string(), pa.int32(), *[pa.int64()] * 3, *[pa.float64()] * 2, pa.int64(), *[pa.float64()] * 2, pa.int64(),
                *[pa.float64()] * 2, pa.int32(), pa.list_(pa.float64())]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

        for batch in embedding(batches) if embedding else batches:
            n = batch.num_rows
            if n == 0:
                continue
            schema, done = batch.schema, []
            model = batch.column("model_name")[0].as_py() if embedding else None
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            secs = batch.column("section").to_numpy(zero_copy_only=False)
            dealt, dealt_section = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dealt", "dealt_section"))
            norm = batch.column("norm_sq").to_numpy(zero_copy_only=False)
            used = ~(norm <= 0) & batch.column("norm_sq").is_valid().to_numpy(zero_copy_only=False)
            vec = batch.column("vec")
            off = vec.offsets.to_numpy()
            off = off - off[0]
            flat = vec.flatten().to_numpy(zero_copy_only=False)
            new_doc = np.ones(n, dtype=bool)
            new_doc[1:] = False
            for c in cols:
                new_doc[1:] |= c[1:] != c[:-1]
            cut = new_doc.copy()
            cut[1:] |= secs[1:] != secs[:-1]
            cut[1:] |= used[1:] != used[:-1]
            starts = np.flatnonzero(cut).tolist() + [n]
            for a, b in zip(starts, starts[1:]):
                key = tuple(c[a] for c in cols)
                held = open_.get(model)
                if held is None or (new_doc[a] and held[0] != key):
                    if held is not None:
                        done.append(held)
                    held = open_[model] = (key, _Document(bool(dealt[a]), small_max))
                doc = held[1]
                doc.n_units += b - a
                if not used[a]:
                    doc.n_zero += int((norm[a:b] <= 0).sum())
                elif all(k is not None for k in key):
                    mat = flat[off[a]:off[b]].reshape(b - a, -1) * (1.0 / np.sqrt(norm[a:b]))[:, None]
                    doc.add(secs[a], bool(dealt_section[a]), mat)
            yield from rows_of(done)
        for held in open_.values():
            yield from rows_of([held])
    return run


def _squares(keys: list[str]):
    """Pieces sorted by group and piece -> a row for each, with the sum of the squares of its added cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [*keys, "section", "kind", "piece"]
        before, cells, sums, schema = None, None, None, None

        def row(key, cells, sums):
            square = float(cells @ cells)
            values = [*key[:-1], *sums, square if key[-1] == 0 else 0.0, 0.0 if key[-1] == 0 else square]
            types = [schema.field(c).type for c in by[:-1]] + [pa.int64(), *[pa.float64()] * 4]
            return [pa.array([v], t) for v, t in zip(values, types)]

        names = [*by[:-1], "n", "t", "q", "s_sq", "g_sq"]
        for batch in batches:
            schema = batch.schema
            out = []
            lists = batch.column("cells")
            off = lists.offsets.to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            firsts = list(zip(*(batch.column(c).to_pylist() for c in ("n", "t", "q"))))
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in by))):
                own = flat[off[i] - off[0]:off[i + 1] - off[0]]
                if key != before:
                    if before is not None:
                        out.append(row(before, cells, sums))
                    before, cells, sums = key, own.copy(), [x or 0 for x in firsts[i]]
                else:
                    cells += own
                    sums = [x + (y or 0) for x, y in zip(sums, firsts[i])]
            for r in out:
                yield pa.RecordBatch.from_arrays(r, names=names)
        if before is not None:
            yield pa.RecordBatch.from_arrays(row(before, cells, sums), names=names)
    return run


def _dealt(vecs: DataFrame, keys: list[str], rows_per_partial: int, small_max: int) -> DataFrame:
    """The rows with ``dealt, dealt_section`` (more than a part has), exchanged by document, or by section and chunk where
    it is dealt, and sorted by section.  The lists of dealt ones are short: one in ``rows_per_partial`` rows at most."""
    most = max(rows_per_partial, small_max)
    documents = materialise(vecs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "dealt-documents")
    if documents.isEmpty():
        tagged = vecs.withColumns({"dealt": F.lit(False), "dealt_section": F.lit(False), "salt": F.lit(0).cast("long")})
        return tagged.repartition(*keys).sortWithinPartitions(*keys, "section").drop("salt")
    sections = materialise(vecs.groupBy(*keys, "section").agg(F.count(F.lit(1)).alias("n_section"))
                           .where(F.col("n_section") > most), "dealt-sections")
    tagged = (vecs.join(documents, keys, "left").join(sections, [*keys, "section"], "left")
              .withColumn("dealt", F.col("n").isNotNull()).withColumn("dealt_section", F.col("n_section").isNotNull()))
    chunks = F.ceil(F.coalesce("n_section", F.lit(1)) / F.lit(rows_per_partial)).cast("long")
    shares = F.ceil(F.col("n") / F.lit(rows_per_partial)).cast("long")
    part = F.when(F.col("dealt"), F.pmod(F.xxhash64("section"), shares))
    # rows of no section are dealt by themselves
    alone = F.col("dealt") & F.col("section").isNull()
    salt = F.when(F.col("dealt_section") | alone, F.pmod(F.xxhash64("major", "minor"), F.when(
        alone, shares).otherwise(chunks))).otherwise(F.lit(0).cast("long"))
    return (tagged.withColumn("part", part).withColumn("salt", salt)
            .repartition(*keys, "part", "salt").sortWithinPartitions(*keys, "section").drop("part", "salt", "n", "n_section"))


def _group_sums(rows: DataFrame, keys: list[str], small_max: int, rows_per_partial: int, native: Callable | None,
                written: bool) -> DataFrame:
    """``keys, n_units, n_zero_vectors`` and numbers of pairs and sums over them: ``t_`` of the document, ``w_`` of its sections."""
    own = [k for k in keys if native is None or k != "model_name"]
    typed = ", ".join("model_name string" if k not in own else f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    dealt, embedding = _dealt(rows, own, rows_per_partial, small_max), None
    if native is not None:
        dealt, embedding = native(dealt)
    parts = dealt.mapInArrow(_parts(keys, small_max, embedding), f"{typed}, {PARTS}")
    if written:
        parts = materialise(parts, "contrast-parts")
    by = [*keys, "section", "kind"]
    pieces = parts.where(F.col("kind") != DONE).select(*by, "piece", "n", "t", "q", "cells")
    pieces = pieces.repartition(*by, "piece").sortWithinPartitions(*by, "piece").mapInArrow(
        _squares(keys), f"{typed}, section string, kind int, n long, t double, q double, s_sq double, g_sq double")
    added = pieces.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "t", "q", "s_sq", "g_sq")])
    zero, none = F.lit(0).cast(PAIRS), F.lit(0.0)
    of = F.col("kind") == OF_DOCUMENT
    n, s1, s2 = pairs_of(F.col("n")), (F.col("s_sq") - F.col("t")) / 2, (F.col("g_sq") - F.col("q")) / 2
    sums = [("t_n_pairs", F.when(of, n).otherwise(zero)), ("t_s1", F.when(of, s1).otherwise(none)),
            ("t_s2", F.when(of, s2).otherwise(none)), ("w_n_pairs", F.when(of, zero).otherwise(n)),
            ("w_s1", F.when(of, none).otherwise(s1)), ("w_s2", F.when(of, none).otherwise(s2))]
    counts = ["n_units", "n_zero_vectors"]
    done = parts.where(F.col("kind") == DONE).select(
        *keys, *counts, pairs_of(F.col("t_n")).alias("t_n_pairs"), "t_s1", "t_s2", F.col("w_n_pairs").cast(PAIRS).alias("w_n_pairs"),
        "w_s1", "w_s2")
    both = done.unionByName(added.select(*keys, *[F.lit(0).cast("long").alias(c) for c in counts],
                                         *[c.alias(name) for name, c in sums]))
    return both.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in counts],
        *[(F.sum(c).cast(PAIRS) if c.endswith("n_pairs") else F.sum(c)).alias(c) for c, _ in sums])


PAIRS = "decimal(38,0)"


def pairs_of(n: Column) -> Column:
    """n (n - 1) / 2 of a long, exact and without overflow: the even factor is halved first."""
    halved = F.when(n % 2 == 0, F.shiftright(n, 1)).otherwise(n)
    other = F.when(n % 2 == 0, n - 1).otherwise(F.shiftright(n - 1, 1))
    return (halved.cast("decimal(19,0)") * other.cast("decimal(19,0)")).cast(PAIRS)


def pair_statistics(vecs: DataFrame, keys: list[str], small_max: int = 64,
                    rows_per_partial: int = 20000) -> DataFrame:
    """``keys, n_pairs, s1 = sum(sim), s2 = sum(sim^2)`` over all unordered
    pairs of non-zero vectors in each group (exact; see module doc)."""
    v = vecs.filter(F.col("norm_sq") > 0).select(
        *keys, F.lit(None).cast("string").alias("section"), "major", "minor", "vec", "norm_sq")
    for k in keys:
        v = v.where(F.col(k).isNotNull())
    return _group_sums(v, keys, small_max, rows_per_partial, None, False).select(
        *keys, F.col("t_n_pairs").alias("n_pairs"), F.col("t_s1").alias("s1"), F.col("t_s2").alias("s2"))


def _moments(prefix: str):
    n, s1, s2 = (F.col(prefix + c).cast("double") for c in ("n_pairs", "s1", "s2"))
    avg = F.when(n > 0, s1 / n).otherwise(F.lit(0.0))
    var = F.when(n > 0, F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0)))
    std = F.when(n > 0, F.sqrt(var)).otherwise(F.lit(0.0))
    return avg, std


def section_contrast(vecs: DataFrame, doc_keys: tuple[str, ...] = ("model_name", "doc"),
                     section_col: str = "section", small_max: int = 64, rows_per_partial: int = 20000,
                     materialize: bool = True, native: Callable | None = None) -> DataFrame:
    """Within/cross-section similarity per document.

    ``vecs`` are section-paragraph vectors (``keys, section, major, minor,
    vec, norm_sq``); they are written first unless ``materialize`` is off
    (the caller already holds a materialised table).  One row per document with
    at least one unit; with no pair of a kind its mean and std are 0, as in the
    evaluated toolkit.  With ``native`` (``embed.native_pass`` of some models) they are
    units with their ``text``, which become vectors in the pass itself.
    """
    keys = list(doc_keys)
    columns = ["text"] if native is not None else ["vec", "norm_sq"]
    rows = vecs.select(*[k for k in keys if native is None or k != "model_name"],
                       F.col(section_col).cast("string").alias("section"), "major", "minor", *columns)
    if materialize:
        # read several times below (numbers of rows, the pass)
        rows = materialise(rows, "contrast-vectors")
    j = _group_sums(rows, keys, small_max, rows_per_partial, native, True)
    j = j.select(*keys, "n_units", "n_zero_vectors",
                 *[F.col("w_" + c).alias("w_" + c) for c in ("n_pairs", "s1", "s2")],
                 *[(F.col("t_" + c) - F.col("w_" + c)).alias("c_" + c) for c in ("n_pairs", "s1", "s2")])
    w_avg, w_std = _moments("w_")
    c_avg, c_std = _moments("c_")
    return j.select(
        *keys, "n_units", "n_zero_vectors",
        F.col("w_n_pairs").cast(PAIRS).alias("n_within_pairs"),
        F.col("c_n_pairs").cast(PAIRS).alias("n_cross_pairs"),
        w_avg.alias("avg_within_section_similarity"),
        c_avg.alias("avg_cross_section_similarity"),
        (w_avg - c_avg).alias("section_boundary_contrast"),
        w_std.alias("within_similarity_std"),
        c_std.alias("cross_similarity_std"))
