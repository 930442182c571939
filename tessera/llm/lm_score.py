"""Language-model scores from a log-frequency Bloom filter.

All words and word pairs of the training texts are counted.  The filter holds
each of them once for every step that its count reaches on a logarithmic
scale, so that probing step after step until one is missing gives the count
back, rounded.  Interpolated probabilities of a text come from such probes.

What is broadcast is bounded: beyond the bound the filter holds the commonest
words and pairs.  The others stay in a table, in ranges of their keys, and what
the filter does not settle is looked up there, with one packed row of distinct
keys for each chunk of texts and range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.compression import remainder
from tessera.llm.dedup import settings, stored
from tessera.llm.packing import portions
from tessera.llm.words import MULTIPLIER, bytes_of, mixed, words_of
from tessera.session import materialise

#: A text's end, counted as a token; white space, so that no word is the same.
END = xxhash.xxh3_64_intdigest(b"\n")
PORTION = 1 << 20
#: Pairs that a task holds before it hands them on.
HELD = 3 << 19
#: Texts that a worker gets at a time: it holds the filter, too.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: Bits of a pair's key; 5 bytes of it are stored, the range has the others.
KEY_BITS = 48
STORED = 5
PROBES = 5
#: Steps of words, and of pairs, which are many more: theirs start at the least count of a pair.
STEP = 1.25
PAIR_STEP = 2.0
ADDED = 0.1
WEIGHTS = (1.0, 10.0, 100.0, 1e3, 1e4, 1e5)
#: Marks a key that is to be looked up, where else a step stands.
OPEN = np.uint64(1 << 63)
#: Tokens to be looked up that a task holds before it hands them on as a chunk.
OPEN_HELD = 1 << 18


def column_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a column's texts, A-Z in lower case, with an end after each text, and where each text starts."""
    words, sizes = words_of(*bytes_of(column))
    first = np.cumsum(sizes + 1) - sizes - 1
    tokens = np.full(len(words) + len(sizes), END, dtype=np.uint64)
    of_words = np.ones(len(tokens), dtype=bool)
    of_words[first + sizes] = False
    tokens[of_words] = words
    return tokens, first


def tokens_of(text: str | None) -> np.ndarray:
    """Hashes of a text's words and of its end; a null text is empty."""
    return column_tokens(pa.array([text or ""]))[0]


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(before * MULTIPLIER + tokens) >> np.uint64(64 - KEY_BITS)


def previous(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each; a text's first one has an end before it."""
    before = np.roll(tokens, 1)
    before[first] = END
    return before


def thresholds(least: int = 1, factor: float = STEP, most: int = 1 << 61) -> np.ndarray:
    """The least count of each step: ``least`` and then one more or ``factor`` times as many, whichever is more."""
    out = [least]
    while out[-1] < most:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * factor)))
    return np.array(out, dtype=np.int64)


def middles(of: np.ndarray) -> np.ndarray:
    """The count that each step stands for: the geometric middle of the counts that reach it and no more."""
    return np.concatenate([[0.0], np.sqrt(of[:-1] * (of[1:] - 1.0)), [float(of[-1])]])


def count_words(texts: DataFrame) -> DataFrame:
    """``token, c``: how often each word, and the end, occurs in ``text``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for tokens, _ in _portions(batches):
            held.append(tokens)
            if sum(map(len, held)) >= HELD:
                yield _counted(held)
                held = []
        if held:
            yield _counted(held)

    parts = texts.select("text").mapInArrow(count, "token long, c long")
    with settings(texts.sparkSession, BATCHES):
        return materialise(parts.groupBy("token").agg(F.sum("c").alias("c")), "lm-words")


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_pydict({"token": pa.array(values.view(np.int64)), "c": pa.array(counts, pa.int64())})


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of some texts together, and where each text starts."""
    for batch in batches:
        column = batch.column(0).fill_null("")
        for low, high in portions(pc.binary_length(column).to_pylist(), PORTION):
            yield column_tokens(column.slice(low, high - low))


def count_pairs(texts: DataFrame, range_bits: int, least: int) -> DataFrame:
    """Word pairs seen ``least`` times or more with their steps, in ranges of their keys, as packed arrays.

    A task sorts its pairs and hands on one packed row for each range; a range
    is small enough for one task by the choice of ``range_bits``.
    """
    shift, scale = np.uint64(KEY_BITS - range_bits), thresholds(least, PAIR_STEP)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for tokens, first in _portions(batches):
            held.append(pair_keys(previous(tokens, first), tokens))
            if sum(map(len, held)) >= HELD:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        return _packed(keys, counts, shift)

    def merge(table: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpacked(k) for k in table.column("keys").to_pylist()])
        counts = np.concatenate([_whole(c, x) for c, x in zip(
            table.column("counts").to_pylist(), table.column("large").to_pylist())])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(counts, heads)
        often = sums >= least
        own = keys[heads][often] | np.uint64(table.column("range")[0].as_py()) << shift
        return pa.Table.from_batches([_packed(own, steps_of(sums[often], scale), shift)], schema=PACKED)

    parts = texts.select("text").mapInArrow(count, PACKED_COLUMNS)
    with settings(texts.sparkSession, BATCHES):
        return materialise(parts.groupBy("range").applyInArrow(merge, PACKED_COLUMNS), "lm-pairs")


PACKED_COLUMNS = "range int, keys binary, counts binary, large binary"
PACKED = pa.schema([("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("large", pa.binary())])


def _packed(keys: np.ndarray, counts: np.ndarray, shift: np.uint64) -> pa.RecordBatch:
    """Sorted keys by range, 5 bytes each, and counts of a byte; those of 255 and more stand whole in ``large``."""
    ranges = (keys >> shift).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(keys) else np.empty(0, int)
    raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :STORED]
    small = np.minimum(counts, 255).astype(np.uint8)
    edges = [*heads.tolist(), len(keys)]
    spans = list(zip(edges, edges[1:]))
    whole = [counts[a:b] for a, b in spans]
    return pa.RecordBatch.from_arrays(
        [pa.array(ranges[heads], pa.int32()), pa.array([raw[a:b].tobytes() for a, b in spans], pa.binary()),
         pa.array([small[a:b].tobytes() for a, b in spans], pa.binary()),
         pa.array([c[c >= 255].astype("<i8").tobytes() for c in whole], pa.binary())], schema=PACKED)


def _whole(counts: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(counts, dtype=np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, dtype="<i8")
    return out


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, STORED)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :STORED] = raw
    return out.view("<u8").ravel()


@dataclass(frozen=True)
class FrequencyFilter:
    """A Bloom filter of (key, step), a segment of bits for each range of keys."""

    range_bits: int
    segment_bits: int
    bits: np.ndarray  # bytes

    def places(self, keys: np.ndarray, step: int) -> Iterator[np.ndarray]:
        """The bits of each key for a step, within its segment."""
        low, high = self._halves(keys, step)
        for i in range(PROBES):
            yield (low + i * high) % self.segment_bits

    def _halves(self, keys: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        value = mixed(keys + np.uint64(step * int(MULTIPLIER) & 0xFFFFFFFFFFFFFFFF))
        return (value & np.uint64(0xFFFFFFFF)).astype(np.int64), (value >> np.uint64(32)).astype(np.int64) | 1

    def probe(self, keys: np.ndarray, step: int) -> np.ndarray:
        """The numbers of the keys that reach the step; one that misses a bit is asked no more."""
        first = (keys >> np.uint64(KEY_BITS - self.range_bits)).astype(np.int64) * self.segment_bits
        low, high = self._halves(keys, step)
        alive = np.arange(len(keys))
        for i in range(PROBES):
            at = first + (low + i * high) % self.segment_bits
            hit = np.flatnonzero((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            alive, first, low, high = alive[hit], first[hit], low[hit], high[hit]
        return alive

    def steps(self, keys: np.ndarray) -> np.ndarray:
        """The steps that each key's count reaches, by probing until one is missing."""
        out = np.zeros(len(keys), dtype=np.int64)
        alive = np.arange(len(keys))
        step = 1
        while len(alive):
            alive = alive[self.probe(keys[alive], step)]
            out[alive] = step
            step += 1
        return out

    def segment(self, keys: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """The bytes of one range's segment."""
        bits = np.zeros(self.segment_bits, dtype=bool)
        for step in range(1, int(steps.max(initial=0)) + 1):
            for at in self.places(keys[steps >= step], step):
                bits[at] = True
        return np.packbits(bits, bitorder="little")


def word_keys(tokens: np.ndarray) -> np.ndarray:
    """Keys of single words, apart from those of pairs."""
    return mixed(tokens ^ MULTIPLIER) >> np.uint64(64 - KEY_BITS)


THRESHOLDS = thresholds()
MIDDLES = middles(THRESHOLDS)


def steps_of(counts: np.ndarray, of: np.ndarray = THRESHOLDS) -> np.ndarray:
    return np.searchsorted(of, counts, side="right")


def build_filter(words: DataFrame, pairs: DataFrame, range_bits: int,
                 filter_bytes: int) -> tuple[FrequencyFilter, tuple[int, int], DataFrame | None]:
    """The filter of all words and of ``pairs``: ten bits an entry, as far as ``filter_bytes`` allow.

    That is the bound of what is broadcast.  Beyond it the rarest words and
    pairs are left out, those of the same step together, until the others fit.
    With it come the least steps of words and of pairs that it holds and, if it
    doesn't hold all, the table of all steps in which the others are found.
    """
    shift = np.uint64(KEY_BITS - range_bits)

    def pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = word_keys(batch.column(0).to_numpy().view(np.uint64))
            order = np.argsort(keys, kind="stable")
            yield _packed(keys[order], steps_of(batch.column(1).to_numpy()[order]), shift)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 256), dtype=np.int64)
        for batch in batches:
            for data, is_pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[int(is_pair)] += np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
        pair, step = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(pair, pa.int32()), "step": pa.array(step, pa.int32()),
                                          "n": pa.array(total[pair, step], pa.int64())})

    singles = words.select("token", "c").mapInArrow(pack_words, PACKED_COLUMNS).withColumn("pair", F.lit(False))
    both = singles.unionByName(pairs.withColumn("pair", F.lit(True)))
    rows = (both.select("counts", "pair").mapInArrow(histogram, "pair int, step int, n long")
            .groupBy("pair", "step").agg(F.sum("n").alias("n")).collect())
    number = {(r["pair"], r["step"]): r["n"] for r in rows}
    entries = sum(n * step for (_, step), n in number.items())
    low = [1, 1]
    while entries * 10 > filter_bytes * 8:
        order = 1 if low[1] <= low[0] else 0  # pairs first: a pair falls back on its word
        entries -= number.get((order, low[order]), 0) * low[order]
        low[order] += 1
    segment_bits = max(1024, -(-entries * 10 // (1 << range_bits) // 8) * 8)
    shape = FrequencyFilter(range_bits, segment_bits, np.empty(0, dtype=np.uint8))

    def fill(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py()
        keys = np.concatenate([_unpacked(k) for k in table.column("keys").to_pylist()])
        own = [np.frombuffer(c, dtype=np.uint8) for c in table.column("counts").to_pylist()]
        steps = np.concatenate([np.where(c >= low[int(p)], c, 0) for c, p in zip(own, table.column("pair").to_pylist())])
        bits = shape.segment(keys | np.uint64(number) << shift, steps)
        return pa.table({"range": pa.array([number], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    size = segment_bits // 8
    bits = np.zeros(size << range_bits, dtype=np.uint8)
    for row in both.groupBy("range").applyInArrow(fill, "range int, bits binary").collect():
        bits[row["range"] * size:(row["range"] + 1) * size] = np.frombuffer(row["bits"], dtype=np.uint8)
    return replace(shape, bits=bits), (low[0], low[1]), both.select("range", "keys", "counts") if low != [1, 1] else None


@dataclass(frozen=True)
class LanguageModel:
    """The filter, the number of training tokens and of distinct ones, and the weight of what a word was seen after.

    The weight is None until :func:`fit_and_score` has chosen it.
    ``frequent`` and ``counts`` are the exact counts of the commonest words, at
    most ``FREQUENT`` of them.  ``least`` are the least steps of words and of
    pairs in the filter; ``entries`` has the steps of all, if the filter has not.
    """

    filter: FrequencyFilter
    tokens: int
    distinct: int
    weight: float | None
    frequent: np.ndarray
    counts: np.ndarray
    least: tuple[int, int]
    entries: DataFrame | None
    least_pair: int = 2

    @property
    def partial(self) -> bool:
        """Whether the filter holds the commonest words and pairs only."""
        return self.least != (1, 1)

    @property
    def total(self) -> float:
        return self.tokens + ADDED * (self.distinct + 1)

    def references(self, tokens: np.ndarray, first: np.ndarray, distinct: tuple[np.ndarray, np.ndarray] | None = None
                   ) -> np.ndarray:
        """For each token the steps of its word, of the word before it and of their pair; an ``OPEN`` key is to be looked up."""
        own, back = distinct or np.unique(tokens, return_inverse=True)
        of_words = self._reference(word_keys(own), self.least[0])
        word = of_words[back]
        before = np.roll(word, 1)
        before[first] = of_words[np.searchsorted(own, END)]
        own, back = np.unique(pair_keys(previous(tokens, first), tokens), return_inverse=True)
        pair = self._reference(own, self.least[1])[back]
        if self.partial:  # a pair is seen as often as each of its words at most
            rare = steps_of(np.array([self.least_pair]))[0]
            pair = np.where((pair >= OPEN) & ((word < rare) | (before < rare)), np.uint64(0), pair)
        return np.stack([word, before, pair])

    def _reference(self, keys: np.ndarray, least: int) -> np.ndarray:
        steps = self.filter.steps(keys).astype(np.uint64)
        # the filter has nothing under the least step: a lower answer is a chance hit
        return np.where(steps < least, keys | OPEN, steps) if self.partial else steps

    def log10(self, steps: np.ndarray, weights: tuple[float, ...], less: int = 0) -> Iterator[np.ndarray]:
        """log10 of each token's probability after the one before it, for one weight after another.

        ``steps`` are those of the words, of the words before and of the pairs.
        A pair's share of the word before it and the word's own share are
        mixed: the oftener the word before was seen, the more the pair counts.
        ``less`` is taken off all counts, for texts that were counted too.
        """
        scales = (MIDDLES, MIDDLES, middles(thresholds(self.least_pair, PAIR_STEP)))
        word, before, pair = (np.maximum(scale[s] - less, 0) for scale, s in zip(scales, steps))
        alone = (word + ADDED) / self.total
        share = np.minimum(np.divide(pair, before, out=np.zeros_like(pair), where=before > 0), 1) - alone
        for weight in weights:
            yield np.log10(before / (before + weight) * share + alone)

    def sums(self, steps: np.ndarray, heads: np.ndarray, weights: tuple[float, ...], training: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
        """For each weight, the sums of the texts that begin at ``heads``, and the sum of ``training`` tokens less their own count."""
        texts = np.zeros((len(weights), len(heads)))
        for out, logs in zip(texts, self.log10(steps, weights)):
            held = np.concatenate([[0.0], np.cumsum(logs)])
            out[:] = np.diff(held[np.append(heads, len(logs))])
        fit = [x.sum() for x in self.log10(steps[:, training], weights, 1)] if len(weights) > 1 else [0.0]
        return texts, np.array(fit)


class OpenTokens:
    """Tokens that the filter doesn't settle, held until they make a chunk.

    A chunk is a packed row of distinct keys for each range, and a row (range
    -1) of its texts (f, r, number of tokens, whether counted) and of the tokens' steps, where
    256 and more stand for the chunk's keys in their order.
    """

    def __init__(self, range_bits: int):
        self.shift = np.uint64(KEY_BITS - range_bits)
        self.texts: list[np.ndarray] = []
        self.references: list[np.ndarray] = []

    def add(self, f: np.ndarray, r: np.ndarray, training: np.ndarray, first: np.ndarray,
            references: np.ndarray) -> np.ndarray:
        """Holds what is open; gives back which tokens are settled."""
        settled = (references < OPEN).all(axis=0)
        at = np.flatnonzero(~settled)
        if len(at):
            n = np.bincount(np.searchsorted(first, at, side="right") - 1, minlength=len(first))
            self.texts.append(np.stack([f, r, n, training])[:, n > 0])
            self.references.append(references[:, at])
        return settled

    def full(self) -> bool:
        return sum(x.shape[1] for x in self.references) >= OPEN_HELD

    def chunk(self) -> dict[str, pa.Array]:
        texts, references = np.concatenate(self.texts, axis=1), np.concatenate(self.references, axis=1)
        self.texts, self.references = [], []
        asked = references >= OPEN
        keys, back = np.unique(references[asked], return_inverse=True)
        references[asked] = (back + 256).astype(np.uint64)
        probes = _packed(keys ^ OPEN, np.ones(len(keys), dtype=np.int64), self.shift)
        number = xxhash.xxh3_64_intdigest(texts[:2, 0].tobytes()) >> 1
        tokens = zstandard.ZstdCompressor(level=1).compress(references.astype("<u4").tobytes())
        return {"chunk": pa.array([number] * (probes.num_rows + 1), pa.int64()),
                "range": pa.array([-1, *probes.column(0).to_pylist()], pa.int32()),
                "keys": pa.array([tokens, *probes.column(1).to_pylist()], pa.binary()),
                "texts": pa.array([texts.astype("<i8").tobytes(), *[None] * probes.num_rows], pa.binary())}


OPEN_COLUMNS = "chunk long, range int, keys binary, texts binary"
OPEN_SCHEMA = pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("keys", pa.binary()), ("texts", pa.binary())])


def _filled(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of all the schema's columns; those not given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c.name] if c.name in columns else pa.nulls(n, c.type) for c in schema],
                                      schema=schema)


def look_up(chunks: DataFrame, model: LanguageModel, weights: tuple[float, ...]) -> DataFrame:
    """``f, r, more, fit``: what the open tokens add to each text for each weight, and to a chunk's fit (``f`` is null).

    The distinct keys of each chunk meet the entries range by range; the steps
    found go back to their chunk, a byte for each key.
    """
    plain = replace(model, entries=None, filter=None, frequent=None, counts=None)

    def answer(asked: pa.Table, entries: pa.Table) -> pa.Table:
        keys = _unpacked(b"".join(entries.column("keys").to_pylist()))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        steps = np.frombuffer(b"".join(entries.column("counts").to_pylist()), dtype=np.uint8)[order]
        packed = asked.column("keys").to_pylist()
        wanted = _unpacked(b"".join(packed))
        found = np.zeros(len(wanted), dtype=np.uint8)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = np.where(keys[at] == wanted, steps[at], 0).astype(np.uint8)
        edges = np.cumsum([0] + [len(k) // STORED for k in packed]).tolist()
        return pa.table({"chunk": asked.column("chunk"), "range": asked.column("range"), "steps": pa.array(
            [found[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())})

    def finish(tokens: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("range")
        steps = np.concatenate([np.arange(256, dtype=np.uint8),
                                np.frombuffer(b"".join(answers.column("steps").to_pylist()), dtype=np.uint8)])
        f, r, n, training = np.frombuffer(tokens.column("texts")[0].as_py(), dtype="<i8").reshape(4, -1)
        data = zstandard.ZstdDecompressor().decompress(tokens.column("keys")[0].as_py())
        of_texts, fit = plain.sums(steps[np.frombuffer(data, dtype="<u4").reshape(3, -1)], np.cumsum(n) - n, weights,
                                   np.repeat(training > 0, n))
        return pa.table({"f": pa.array([*f.tolist(), None], pa.int64()), "r": pa.array([*r.tolist(), None], pa.int64()),
                         "more": pa.array([*of_texts.T.tolist(), None], pa.list_(pa.float64())),
                         "fit": pa.array([None] * len(f) + [fit.tolist()], pa.list_(pa.float64()))})

    probes = chunks.where(F.col("range") >= 0).select("chunk", "range", "keys")
    answers = (probes.groupBy("range").cogroup(model.entries.groupBy("range"))
               .applyInArrow(answer, "chunk long, range int, steps binary"))
    tokens = chunks.where(F.col("range") == -1).select("chunk", "keys", "texts")
    return tokens.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        finish, "f long, r long, more array<double>, fit array<double>")


FREQUENT = 1 << 18


def learn_language_model(texts: DataFrame, filter_bytes: int = 48 << 20,
                         least_pair: int = 2) -> tuple[LanguageModel, DataFrame]:
    """The model of ``texts`` (text) without its weight, and the exact counts of all their words (token, c).

    Pairs seen fewer than ``least_pair`` times are left to their words.
    """
    size = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    range_bits = min(24, max(KEY_BITS - 8 * STORED, math.ceil(math.log2(max(size, 1) / (16 << 20)))))
    words = count_words(texts)
    pairs = count_pairs(texts, range_bits, least_pair)
    total = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()

    scale = F.array(*[F.lit(int(t)) for t in THRESHOLDS[:64].tolist()])
    number = {r["step"]: r["n"] for r in words.groupBy(F.size(F.filter(scale, lambda t: t <= F.col("c"))).alias("step"))
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    step = max(number, default=1)
    held = 0
    while step > 0 and held + number.get(step, 0) <= FREQUENT:
        held += number.get(step, 0)
        step -= 1
    common = words.where(F.col("c") >= int(THRESHOLDS[step])).toArrow()
    frequent = common.column("token").to_numpy().view(np.uint64)
    order = np.argsort(frequent)
    own, lowest, entries = build_filter(words, pairs, range_bits, filter_bytes)
    return LanguageModel(own, total["n"] or 0, total["v"], None, frequent[order], common.column("c").to_numpy()[order],
                         lowest, entries, least_pair), words


SCORED = ("f long, r long, doc_id long, held_out boolean, n_tokens long, known long, base double, scores array<double>, "
          f"rare array<long>, times array<long>, fit array<double>, {OPEN_COLUMNS}")
SCORED_SCHEMA = pa.schema([
    ("f", pa.int64()), ("r", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
    ("known", pa.int64()), ("base", pa.float64()), ("scores", pa.list_(pa.float64())), ("rare", pa.list_(pa.int64())),
    ("times", pa.list_(pa.int64())), ("fit", pa.list_(pa.float64())), *OPEN_SCHEMA])


def score_texts(docs: DataFrame, model: LanguageModel, words: DataFrame) -> DataFrame:
    """:func:`fit_and_score` with the weight that the model has."""
    return fit_and_score(docs, model, words, (model.weight,))[1]


def fit_and_score(docs: DataFrame, model: LanguageModel, words: DataFrame,
                  weights: tuple[float, ...] = WEIGHTS) -> tuple[LanguageModel, DataFrame]:
    """The model with the best of ``weights``; ``doc_id, held_out, n_tokens, n_known, base_score, score`` of each row.

    ``docs`` (doc_id, held_out, text) is a :func:`stored` table.  Its rows that
    are not held out are the texts that were counted: the weight is the one that
    suits all of them best with their own counts taken off.  A task sums up the
    fits of its texts, and scores go on for all weights until one is chosen, so
    that every text is read once.

    Counts of common words are sent along; the others are joined by word, so
    that the base score is exact whatever the number of words.  What the filter
    has no room for is looked up.  Null texts are empty and have the end alone;
    a null ``held_out`` counts as true; every row is scored, repeated rows too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(replace(model, entries=None))
    range_bits = model.filter.range_bits

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fit = OpenTokens(range_bits), np.zeros(len(weights))
        for batch in batches:
            texts = batch.column(4).fill_null("")
            for low, high in portions(pc.binary_length(texts).to_pylist(), PORTION):
                rows, more = _scored(batch.slice(low, high - low), sent.value, held, weights)
                fit += more
                yield rows
                if held.full():
                    yield _filled(held.chunk(), SCORED_SCHEMA)
        if held.texts:
            yield _filled(held.chunk(), SCORED_SCHEMA)
        yield _filled({"fit": pa.array([fit.tolist()], pa.list_(pa.float64()))}, SCORED_SCHEMA)

    rows = (docs.select(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"),
                        F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text"))
    with settings(docs.sparkSession, BATCHES):
        table = materialise(rows.mapInArrow(score, SCORED), "lm-scores")
    fits = table.where("fit is not null").select("fit")
    scored = table.where("chunk is null and fit is null").drop("fit", *OPEN_SCHEMA.names)
    found = None
    if model.partial:
        chunks = table.where("chunk is not null").select(*OPEN_SCHEMA.names)
        found = materialise(look_up(chunks, model, weights), "lm-looked-up")
        fits = fits.unionByName(found.where("fit is not null").select("fit"))
    best = 0
    if len(weights) > 1:
        sums = fits.select(F.posexplode("fit").alias("weight", "fit")).groupBy("weight").agg(F.sum("fit").alias("fit"))
        best = max(sums.collect(), key=lambda r: (r["fit"], -r["weight"]))["weight"] if not fits.isEmpty() else 0
    scored = scored.withColumn("score", F.col("scores")[best]).drop("scores")
    if found is not None:
        own = found.where("f is not null").select("f", "r", F.col("more")[best].alias("found"))
        # a very long text may be in several chunks
        scored = (scored.join(own.groupBy("f", "r").agg(F.sum("found").alias("found")), ["f", "r"], "left")
                  .withColumn("score", F.col("score") + F.coalesce("found", F.lit(0.0))).drop("found"))
    rare = scored.select("f", "r", F.explode(F.arrays_zip("rare", "times")).alias("t")).select(
        "f", "r", F.col("t.rare").alias("token"), F.col("t.times").alias("times"))
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = (rare.join(words, "token", "left").groupBy("f", "r")
            .agg(F.sum(F.col("times") * F.log10((c + ADDED) / model.total)).alias("more"),
                 F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known")))
    return replace(model, weight=weights[best]), scored.join(rest, ["f", "r"], "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def _scored(batch: pa.RecordBatch, model: LanguageModel, held: OpenTokens,
            weights: tuple[float, ...]) -> tuple[pa.RecordBatch, np.ndarray]:
    tokens, first = column_tokens(batch.column(4).fill_null(""))
    sizes = np.diff(np.append(first, len(tokens)))
    training = ~batch.column(3).fill_null(True).to_numpy(zero_copy_only=False)
    distinct = np.unique(tokens, return_inverse=True)
    references = model.references(tokens, first, distinct)
    settled = held.add(batch.column(0).to_numpy(), batch.column(1).to_numpy(), training, first, references)
    heads = np.concatenate([[0], np.cumsum(settled)])[first]
    scores, fit = model.sums(references[:, settled], heads, weights, np.repeat(training, sizes)[settled])
    counts = np.zeros(len(tokens))
    if len(model.frequent):
        at = np.minimum(np.searchsorted(model.frequent, distinct[0]), len(model.frequent) - 1)
        counts = np.where(model.frequent[at] == distinct[0], model.counts[at], 0)[distinct[1]]
    common = counts > 0
    base = np.add.reduceat(np.where(common, np.log10((counts + ADDED) / model.total), 0), first)
    rare = np.flatnonzero(~common)
    document = np.repeat(np.arange(len(sizes)), sizes)[rare]
    order = np.lexsort((tokens[rare], document))
    document, word = document[order], tokens[rare][order]
    heads = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (document[1:] != document[:-1])])) \
        if len(word) else np.empty(0, dtype=np.int64)
    offsets = pa.array(np.searchsorted(document[heads], np.arange(len(sizes) + 1)), pa.int32())
    times = np.diff(np.append(heads, len(word)))
    columns = [*(batch.column(i) for i in range(4)), pa.array(sizes, pa.int64()),
               pa.array(np.add.reduceat(common.astype(np.int64), first)), pa.array(base),
               pa.array(scores.T.tolist(), pa.list_(pa.float64())),
               pa.ListArray.from_arrays(offsets, pa.array(word[heads].view(np.int64))),
               pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))]
    return _filled(dict(zip(SCORED_SCHEMA.names, columns)), SCORED_SCHEMA), fit


def language_model_report(docs: DataFrame) -> DataFrame:
    """The query: learn from rows whose crc32(doc_id) mod 10 is not 0, score all."""
    marked = stored(docs).withColumn("held_out", remainder("doc_id", 10) == 0)
    model, words = learn_language_model(marked.where(~F.col("held_out")).select("text"))
    return fit_and_score(marked, model, words)[1]
