"""Sum-of-squares online packing of documents into token windows.

A worker keeps, for each fill level, the windows that are filled so far.  A
document goes to the level where placing it leaves the smallest sum of squared
counts of partly filled windows, or opens a window if that does.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.tokencount import Recent, byte_symbols, vocabulary

IDS = np.dtype("<u4")
#: Bytes of text whose parts are encoded at a time.
PORTION = 1 << 20
COLUMNS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


#: Texts of these characters alone are cut into words here; the tokenizer takes parts of others.
SIMPLE = re.compile("[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: Fixed by the vocabulary: how a lower-case text falls apart into words.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xff]+|[0-9]|[^\\s0-9a-z\xdf-\xff]+", re.ASCII)
LONGEST_WORD = 24
#: Words whose merges are made together.
WORDS_AT_ONCE = 2048
ASCII_SPACE = re.compile("[\t-\r ]+")


class PairMerger:
    """Byte-pair merges of many words at a time, as arrays: a row for each word, a merge a round in every row."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        self.inner = np.array([vocabulary[c] for c in byte_symbols()], dtype=np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in byte_symbols()], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit bytes."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))  # words of about one length are one array
        done: list = [None] * len(words)
        for start in range(0, len(order), WORDS_AT_ONCE):
            some = order[start:start + WORDS_AT_ONCE]
            for i, ids in zip(some, self._merged([words[i] for i in some])):
                done[i] = ids
        return done

    def _merged(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        columns, rows = np.arange(width), np.arange(len(words))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(-1, width)
        symbols = self.inner[raw]
        symbols[rows, sizes - 1] = self.last[raw[rows, sizes - 1]]
        pairs = np.full((len(words), width), self.NONE, dtype=np.int32)
        pairs[:, :-1] = np.where(columns[1:] < sizes[:, None], self.rank(symbols[:, :-1], symbols[:, 1:]), self.NONE)
        done: list = [None] * len(words)
        while True:
            place = pairs.argmin(axis=1)
            own = np.arange(len(rows))
            low = pairs[own, place]
            over = low == self.NONE
            if over.any():
                flat = symbols[over][columns < sizes[over][:, None]].astype(IDS).tobytes()
                ends = np.cumsum(sizes[over]) * 4
                for row, start, end in zip(rows[over].tolist(), (ends - sizes[over] * 4).tolist(), ends.tolist()):
                    done[row] = flat[start:end]
                live = ~over
                if not live.any():
                    return done
                rows, symbols, pairs, sizes, place, low = (x[live] for x in (rows, symbols, pairs, sizes, place, low))
                own = np.arange(len(rows))
            source = np.minimum(columns + (columns > place[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, source, axis=1)
            pairs = np.take_along_axis(pairs, source, axis=1)
            symbols[own, place] = new = self.merged[low]
            sizes = sizes - 1
            right = np.minimum(place + 1, width - 1)
            pairs[own, place] = np.where(place + 1 < sizes, self.rank(new, symbols[own, right]), self.NONE)
            before = place > 0
            pairs[own[before], place[before] - 1] = self.rank(symbols[own[before], place[before] - 1], new[before])


class WordEncoder:
    """Ids of texts for a vocabulary that drops white space, as little-endian unsigned 32-bit bytes.

    The ids of a lower-case word are made once, many words at a time, and kept
    for a while.  A part of a text with other characters than ``SIMPLE`` ones
    goes to the tokenizer, since such a vocabulary treats the parts between
    white space apart from each other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merger = PairMerger(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.words = Recent(self._library, 300_000, LONGEST_WORD)

    def _library(self, part: str) -> bytes:
        ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return np.array(ids, dtype=IDS).tobytes()

    def simple(self, text: str) -> bool:
        return SIMPLE.fullmatch(text) is not None and not any(s in text for s in self.special)

    def cut(self, text: str) -> list[str]:
        """The words of a text, each of which has ids of its own."""
        if self.simple(text):
            return WORDS.findall(text.lower())
        return [w for part in ASCII_SPACE.split(text) if part
                for w in (WORDS.findall(part.lower()) if self.simple(part) else [part])]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut, words, parts = [], set(), set()
        for text in texts:
            simple = self.simple(text)
            own = WORDS.findall(text.lower()) if simple else self.cut(text)
            (words if simple else parts).update(own)
            cut.append(own)
        words.update(w for w in parts if SIMPLE.fullmatch(w) and WORDS.fullmatch(w))
        kept, old = self.words, self.words.old
        ids = {w: own for w in words | parts if (own := kept.get(w)) is not None}
        found = {w: old[w] for w in (words | parts) - ids.keys() if w in old}
        new = [w for w in words - ids.keys() - found.keys() if len(w) <= LONGEST_WORD]
        found.update(zip(new, self.merger.encode([w.encode() for w in new])))
        kept.make_room(len(found))
        kept.update(found)
        ids |= found
        ids.update((w, kept[w]) for w in (words | parts) - ids.keys())
        return [b"".join(map(ids.__getitem__, own)) for own in cut]


def portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that have ``most`` together, or one that has more alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, kept from task to task."""
    return WordEncoder(path)


class SquaresPacker:
    """Windows of ``capacity`` tokens; ``place`` and ``close`` return finished pieces.

    A piece is (document, start, ids, document's tokens); it is finished once
    its window and offset can't change any more.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)  # partly filled windows by level
        self.open: dict[int, list[list[tuple]]] = {}
        self.windows = 0

    def level_for(self, size: int) -> int:
        """The level to place ``size`` at; 0 opens a window.  Ties: the fullest level."""
        top = self.capacity - size
        n = self.count
        change = 2 * (n[size + 1:self.capacity + 1] - n[1:top + 1]) + 2
        if len(change):
            change[-1] -= 1  # a full window counts no more
            change = np.where(n[1:top + 1] > 0, change, np.iinfo(np.int64).max)
            best = len(change) - int(change[::-1].argmin())
            if change[best - 1] <= 2 * n[size] + 1:
                return best
        return 0

    def place(self, piece: tuple, size: int) -> list[tuple]:
        if size == self.capacity:
            return self._finished([piece])
        level = self.level_for(size)
        window = []
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        window.append(piece)
        level += size
        if level == self.capacity:
            return self._finished(window)
        self.open.setdefault(level, []).append(window)
        self.count[level] += 1
        return []

    def close(self) -> list[tuple]:
        """Merge the windows still partly filled, fullest first, cutting a piece only where a window ends."""
        out, window, room = [], [], self.capacity
        for level in sorted(self.open, reverse=True):
            for doc, start, ids, tokens in (p for w in self.open[level] for p in w):
                while ids:
                    part, ids = ids[:room * 4], ids[room * 4:]
                    window.append((doc, start, part, tokens))
                    start += len(part) // 4
                    room -= len(part) // 4
                    if not room:
                        out += self._finished(window)
                        window, room = [], self.capacity
        self.open.clear()
        self.count[:] = 0
        return out + (self._finished(window) if window else [])

    def _finished(self, window: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for doc, start, ids, tokens in window:
            out.append((doc, start, len(ids) // 4, ids, tokens, self.windows, offset))
            offset += len(ids) // 4
        self.windows += 1
        return out


def pack(docs: DataFrame, path: str | None = None, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all documents (``doc_id``, ``text``), each with its window and place there.

    A document's ids are those of its text, then ``end_id``; a null or empty
    text has the end alone.  A document longer than a window gives full windows
    first and its rest is packed.  ``ids``: little-endian unsigned 32-bit.
    Each input partition is packed for itself and has its own ``sequence_id``s;
    at its end the windows that are partly filled are merged, so that it pads
    one window at most.  A worker holds the open windows only.  Repeated rows
    are packed each; a null ``doc_id`` stays null; other columns are not read.
    """
    path = path or vocabulary("word_bpe_49k.json")
    end = array("I", [end_id]).tobytes() if end_id is not None else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        words, packer = encoder(path), SquaresPacker(window)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).fill_null("")
            for low, high in portions(pc.binary_length(texts).to_pylist(), PORTION):
                out: list[tuple] = []
                ids_of = words.encode(texts.slice(low, high - low).to_pylist())
                for doc, ids in zip(keys.slice(low, high - low).to_pylist(), ids_of):
                    ids += end
                    tokens = len(ids) // 4
                    for start in range(0, tokens, window):
                        part = ids[start * 4:(start + window) * 4]
                        out += packer.place((doc, start, part, tokens), len(part) // 4)
                if out:
                    yield _batch(out, first)
        if out := packer.close():
            yield _batch(out, first)

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, COLUMNS)


def _batch(pieces: list[tuple], first: int) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*pieces)]
    columns[5] = [first + w for w in columns[5]]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)
