"""Token counts by byte-pair merging with a heap over a linked list.

A text falls apart into pieces at white space and word borders.  A piece's
symbols are nodes of a linked list and its adjacent pairs that can merge lie in
a heap by rank; the lowest pair is popped and merged until none is left.  The
count is the number of first symbols less the number of merges, so that no
identifier is ever looked up.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.compression import values

WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def piece_pattern(letters: str, numbers: str, white: str) -> str:
    """Fixed by the vocabulary: how a text falls apart into pieces, given the characters of each class."""
    return (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{white}{letters}{numbers}]+"
            rf"|[{white}]+(?![^{white}])|[{white}]+")


PIECES = regex.compile(piece_pattern(r"\p{L}", r"\p{N}", WHITE))
#: The same for texts of the characters up to U+00FF, which the faster module can do.
WESTERN = re.compile("[\x00-\xff]*")
WESTERN_PIECES = re.compile(piece_pattern(r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff",
                                          r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"))


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it can be printed, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(moved)) for b in range(256)]


class Recent(dict):
    """A mapping that computes what it lacks and forgets what was not asked for lately.

    At most ``2 * limit`` entries; keys longer than ``longest`` are not kept.
    """

    def __init__(self, compute, limit: int = 150_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            self.make_room(1)
            self[key] = value
        return value

    def make_room(self, entries: int) -> None:
        if len(self) + entries > self.limit:
            self.old = dict(self)
            self.clear()


def merge_count(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> int:
    """How many of ``symbols`` are left after all merges, lowest rank first, then leftmost.

    ``ranks`` has the rank of a pair under ``left << 32 | right``; ``merged``
    the symbol that each rank makes.  A heap entry is ``rank << 32 | place``.
    """
    n = left = len(symbols)
    rank = ranks.get
    pairs = [rank(a << 32 | b, -1) for a, b in zip(symbols, symbols[1:])]
    pairs.append(-1)
    heap = [r << 32 | i for i, r in enumerate(pairs) if r >= 0]
    heapq.heapify(heap)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while heap:
        entry = heapq.heappop(heap)
        i = entry & 0xFFFFFFFF
        if pairs[i] != entry >> 32:
            continue  # one of the two was merged since
        symbols[i] = new = merged[entry >> 32]
        left -= 1
        j = after[i]
        pairs[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            pairs[i] = r = rank(new << 32 | symbols[k], -1)
            if r >= 0:
                heapq.heappush(heap, r << 32 | i)
        else:
            pairs[i] = -1
        if (h := before[i]) >= 0:
            pairs[h] = r = rank(symbols[h] << 32 | new, -1)
            if r >= 0:
                heapq.heappush(heap, r << 32 | h)
    return left


class BytePairCounter:
    """Counts tokens of texts for a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        number = spec["model"]["vocab"]  # numbers stand for symbols; none is given out
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {number[a] << 32 | number[b]: i for i, (a, b) in enumerate(merges)}
        self.merged = [number[a + b] for a, b in merges]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.symbols = [number[c] for c in byte_symbols()]
        self.pieces = Recent(self._piece, 150_000, 40)

    def _piece(self, piece: str) -> int:
        return merge_count([self.symbols[b] for b in piece.encode()], self.ranks, self.merged)

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        for part in parts:
            pattern = WESTERN_PIECES if WESTERN.fullmatch(part) else PIECES
            total += sum(map(self.pieces.__getitem__, pattern.findall(part)))
        return total


@functools.cache
def counter(path: str) -> BytePairCounter:
    """One counter for each Python worker, kept from task to task."""
    return BytePairCounter(path)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text, without begin or end; a null text counts as empty.

    ``path``: a byte-level vocabulary that every worker can open.
    """
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(path)
        for batch in batches:
            yield pa.array([own.count(t) if t else 0 for t in values(batch)], type=pa.int64())

    return F.arrow_udf(count, "long")(text)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    Null texts count as empty: 0 bytes, 0 tokens.  Columns of those names are
    replaced; all others pass through.  Every row is kept.
    """
    path = path or vocabulary("byte_bpe_50k.json")
    return (docs.withColumn("n_tokens", token_count(F.col("text"), path))
            .withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
