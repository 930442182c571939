"""Benchmark passages in documents by q-gram lemma filtering.

A passage of m characters that occurs with e edits at most shares at least
m + 1 - q (e + 1) of its q-grams with the place, all of them on diagonals that
lie e apart at most.  Shared q-grams are counted in overlapping bands of
diagonals; only bands that reach the bound are looked at, by an alignment
that is banded too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHES = "doc_id long, item_id long, start long, end long, edits int, similarity double"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                    ("edits", pa.int32()), ("similarity", pa.float64())])
#: Most characters of documents that are looked at together, and of one document at a time.
PORTION = 1 << 20
FILTER_BITS = 22
MIX = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of a text in lower case, as code points, and their places in the text."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a few letters become two
        lowered = "".join(c if len(c) == 1 else c[0] for c in map(str.lower, text))
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    places = np.flatnonzero(KEPT[np.minimum(points, len(KEPT) - 1)])
    return points[places], places


#: Whether a character counts; all from U+2000 on do, but for that block's signs and spaces.
KEPT = np.array([chr(c).isalnum() for c in range(0x3100)] + [True])


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place on; 8 bytes a place."""
    value = points.astype(np.uint64) * MIX
    value ^= value >> np.uint64(29)
    # doubling: h(2n) from two h(n); the bits of q say which lengths to put together
    out, length, base = None, 0, np.uint64(0xD6E8FEB86659FD93)
    step = 1
    while True:
        if q & step:
            out = value if out is None else out[:len(value) - length] * base + value[length:][:len(out) - step]
            length += step
        if (step << 1) > q:
            break
        value = value[:-step] * base + value[step:] if len(value) > step else value[:0]
        base = np.uint64(int(base) ** 2 & 0xFFFFFFFFFFFFFFFF)
        step <<= 1
    out = out[:max(len(points) - q + 1, 0)].copy()
    out ^= out >> np.uint64(31)
    out *= MIX
    return out


@dataclass(frozen=True)
class PassageIndex:
    """Q-grams of a block of passages, sorted by hash, and a bit for each that may be there."""

    q: int
    ids: list[int]
    passages: list[np.ndarray]
    budgets: np.ndarray
    needed: np.ndarray
    hashes: np.ndarray
    owners: np.ndarray
    places: np.ndarray
    seen: np.ndarray
    fewest: int
    overlap: int

    @classmethod
    def of(cls, items: list[tuple[int, str]], q: int, rate: float) -> PassageIndex | None:
        """``rate``: edits for each character of a passage, lowered where the lemma would leave no q-gram."""
        ids, passages, grams, owners, places = [], [], [], [], []
        for item, text in items:
            points, _ = letters(text or "")
            if len(points) >= q:
                own = gram_hashes(points, q)
                grams.append(own)
                owners.append(np.full(len(own), len(ids), dtype=np.int32))
                places.append(np.arange(len(own), dtype=np.int32))
                ids.append(item)
                passages.append(points)
        if not ids:
            return None
        sizes = np.array([len(p) for p in passages])
        budgets = np.minimum((sizes * rate).astype(np.int64), (sizes - q) // q)
        hashes = np.concatenate(grams)
        order = np.argsort(hashes, kind="stable")
        seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        seen[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        needed = sizes + 1 - q * (budgets + 1)
        return cls(q, ids, passages, budgets, needed, hashes[order], np.concatenate(owners)[order],
                   np.concatenate(places)[order], seen, int(needed.min()),
                   int(2 * sizes.max() + 4 * budgets.max()) + q)

    def shared(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every q-gram that ``points`` shares with a passage: place, passage, place there."""
        hashes = gram_hashes(points, self.q)
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        low = np.searchsorted(self.hashes, hashes[at])
        high = np.searchsorted(self.hashes, hashes[at], side="right")
        counts = high - low
        if not counts.any():
            return at[:0], self.owners[:0], at[:0]
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return np.repeat(at, counts), self.owners[rows], self.places[rows]

    def bands(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """(passage, first and last diagonal) of every band that reaches its passage's bound.

        The diagonals of one occurrence lie ``budget`` apart at most, so that
        bands twice as wide that overlap by half hold it in one of them.
        """
        at, owner, place = self.shared(points)
        if not len(at):
            return []
        diagonal = at - place + (1 << 31)  # not negative
        width = np.maximum(self.budgets, 1)[owner]
        found: dict[int, list[tuple[int, int]]] = {}
        for shift in (0, 1):
            key = owner.astype(np.int64) << 40 | (diagonal + shift * width) // (2 * width)
            values, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            for i in np.flatnonzero(counts >= self.needed[values >> 40]).tolist():
                passage, number = int(values[i]) >> 40, int(values[i]) & ((1 << 40) - 1)
                # each q-gram of the passage counts once, however often the text repeats it
                if len(np.unique(place[inverse == i])) >= self.needed[passage]:
                    step = max(int(self.budgets[passage]), 1)
                    first = number * 2 * step - shift * step - (1 << 31)
                    found.setdefault(passage, []).append((first, first + 2 * step - 1))
        out = []
        for passage, spans in found.items():
            spans.sort()
            first, last = spans[0]
            for low, high in spans[1:]:
                if low > last + 1:
                    out.append((passage, first, last))
                    first = low
                last = max(last, high)
            out.append((passage, first, last))
        return out

    def matches(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(passage, start, end, edits) within the budget: the best place among bands that touch, and any other there."""
        out = []
        for passage, first, last in self.bands(points):
            own, budget = self.passages[passage], int(self.budgets[passage])
            regions = [(max(first - budget, 0), max(last + len(own) + budget, 0) + 1)]
            while regions:
                start, stop = regions.pop()
                if hit := align(own, points[start:stop], budget):
                    a, b, edits = hit
                    out.append((passage, start + a, start + b, edits))
                    # bands that touch may hold several occurrences
                    regions += [r for r in ((start, start + a), (start + b, min(stop, len(points))))
                                if r[1] - r[0] >= len(own) - budget]
        return sorted(out)


def align(passage: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """The place in ``region`` with the fewest edits from ``passage``: start, end, edits; none over the budget.

    Whole rows are computed together; the region is no wider than the band
    that the q-grams left.  Of equal places the first end and then the longest
    span is taken.
    """
    if (at := region.tobytes().find(passage.tobytes())) >= 0 and at % 4 == 0:
        return at // 4, at // 4 + len(passage), 0
    last = _last_row(passage, region)
    end = int(last.argmin())
    edits = int(last[end])
    if edits > budget:
        return None
    back = _last_row(passage[::-1], region[:end][::-1], free=False)
    # back[i]: edits of the passage against the i characters before the end
    length = int(np.flatnonzero(back == edits).max())
    return end - length, end, edits


def _last_row(passage: np.ndarray, region: np.ndarray, free: bool = True) -> np.ndarray:
    """Edits of the whole passage against what ends at each place; ``free``: it may start anywhere."""
    steps = np.arange(len(region) + 1, dtype=np.int32)
    row = np.zeros(len(region) + 1, dtype=np.int32) if free else steps.copy()
    new, down = np.empty_like(row), np.empty(len(region), dtype=np.int32)
    unequal = {int(c): (region != c).astype(np.int32) for c in np.unique(passage)}
    for i, point in enumerate(passage.tolist(), 1):
        new[0] = i
        np.add(row[:-1], unequal[point], out=new[1:])
        np.add(row[1:], 1, out=down)
        np.minimum(new[1:], down, out=new[1:])
        new -= steps  # an edit along the row costs one a place
        np.minimum.accumulate(new, out=new)
        new += steps
        row, new = new, row
    return row


def _windows(points: np.ndarray, index: PassageIndex) -> Iterator[tuple[int, np.ndarray]]:
    """A long document in pieces that overlap by the longest passage with its edits."""
    step = max(PORTION, index.overlap)
    for start in range(0, max(len(points) - index.overlap, 1), step):
        yield start, points[start:start + step + index.overlap]


def find_in(docs: list[tuple[int | None, str]], index: PassageIndex) -> list[tuple]:
    """Rows of ``MATCHES`` for the documents of one portion, which are hashed as one array."""
    parts = [letters(text) for _, text in docs]
    gap = np.zeros(index.q, dtype=np.uint32)  # stands for no character, and keeps documents apart
    starts = np.cumsum([0] + [len(p) + index.q for p, _ in parts])
    joined = np.concatenate([x for p, _ in parts for x in (p, gap)])
    hashes = gram_hashes(joined, index.q)
    possible = np.flatnonzero(index.seen[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    out = []
    edges = np.searchsorted(possible, starts)
    for (doc, _), (points, places), (low, high) in zip(docs, parts, pairwise(edges)):
        if high - low < index.fewest:
            continue
        hits = {}
        for start, window in _windows(points, index):
            for passage, a, b, edits in index.matches(window):
                hits[passage, start + a, start + b] = edits
        for (passage, a, b), edits in sorted(hits.items()):
            size = len(index.passages[passage])
            out.append((doc, index.ids[passage], int(places[a]), int(places[b - 1]) + 1, edits, 1 - edits / size))
    return out


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """The passages in blocks of about ``block_bytes``, by a hash of the item."""
    total = benchmark.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for block in range(blocks):
        rows = benchmark.where(number == block).select("item_id", "text").distinct().collect()
        yield sorted(((r["item_id"], r["text"]) for r in rows if r["text"]),
                     key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def find_passages(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.1,
                  block_bytes: int = 2 << 20) -> DataFrame:
    """Where passages of ``benchmark`` (item_id, text) occur in ``docs`` (doc_id, text).

    One row for each place: ``doc_id``, ``item_id``, ``start`` and ``end`` in
    code points, ``edits`` and ``similarity`` (1 - edits / length).  Only
    letters and digits count, in lower case.  A place matches with up to
    ``rate`` edits a character.  Null and empty texts, and passages of fewer
    than ``q`` letters and digits, match nothing; a passage with a null item_id
    is looked for like any other and reported with that; repeated rows of ``docs``
    give repeated matches.  Passages reach the workers in blocks of a bounded
    size, a pass over the documents each.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").where(F.length("text") >= q)
    out = None
    for items in blocks_of(benchmark, block_bytes):
        index = PassageIndex.of(items, q, rate)
        if index is None:
            continue
        found = rows.mapInArrow(_searcher(spark.sparkContext.broadcast(index)), MATCHES)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], MATCHES) if out is None else out


def _searcher(sent):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.packing import portions
        for batch in batches:
            for low, high in portions(pc.utf8_length(batch.column(1)).to_pylist(), PORTION):
                part = batch.slice(low, high - low)
                found = find_in(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist())), sent.value)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(zip(*found), SCHEMA)], schema=SCHEMA)
    return search


def clean_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no passage occurs; rows with a null doc_id are judged by their text."""
    spark = docs.sparkSession
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"),
                   F.xxhash64("text").alias("text"))
    named = docs.select(F.struct("*").alias("record"), key.alias("key"))
    keyed = named.select(F.xxhash64("key").alias("doc_id"), F.col("record.text").alias("text"))
    dirty = find_passages(keyed, benchmark).select("doc_id").distinct()
    return (named.withColumn("doc_id", F.xxhash64("key")).join(dirty, "doc_id", "left_anti")
            .select("record.*"))
