"""Byte-pair encoding and decoding by a pair occurrence index.

The distinct words of a portion of texts lie one after the other in one list of
symbols.  An index maps each pair that can merge to all its places in the list.
Ranks are applied in ascending order, each at all its places, and a merge puts
the pairs that it makes with its neighbours into their lists.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.compression import values
from tessera.llm.packing import ASCII_SPACE, SIMPLE, portions
from tessera.llm.tokencount import byte_symbols, vocabulary

IDS = np.dtype("<u4")
#: Bytes of text whose words are encoded together.
PORTION = 4 << 20
#: Words whose ids a worker keeps, and the length of the longest of them.
KEPT = 200_000
LONGEST_WORD = 32
#: Fixed by the vocabulary: how the UTF-8 bytes of a lower-case text of simple characters fall apart into words.
WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\s0-9a-z\x80-\xff]+")


class MergeTable:
    """Merges in the order of their ranks: ``left``, ``right`` and ``made`` symbols."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        self.left, self.right, self.made = left, right, made
        keys = left << 32 | right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        # a merge makes no pair of a lower rank, so that ranks can be applied one after the other to all words at once
        first = np.full(int(made.max(initial=-1)) + 1 if len(made) else 0, -1, dtype=np.int64)
        first[made] = np.arange(len(made))
        for part in (left, right):
            known = part < len(first)
            if (first[part[known]] >= np.arange(len(made))[known]).any():
                raise ValueError("a merge uses a symbol that a later merge makes")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it does not merge; a negative symbol merges with none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.order[at], -1) if len(self.keys) else \
            np.full(len(key), -1)


class PairIndex:
    """The places of each pair that can merge, by its rank."""

    def __init__(self) -> None:
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, ranks: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)] if len(ranks) else []
        for low, high in zip(edges, edges[1:]):
            r = int(ranks[low])
            if r in self.places:
                self.places[r].append(places[low:high])
            elif r >= 0:
                self.places[r] = [places[low:high]]
                heapq.heappush(self.active, r)

    def lowest(self) -> tuple[int, np.ndarray]:
        r = heapq.heappop(self.active)
        places = np.sort(np.concatenate(self.places.pop(r)))
        return r, places[np.append(True, places[1:] != places[:-1])]


def apply_ranks(symbols: np.ndarray, merges: MergeTable) -> np.ndarray:
    """``symbols`` after all merges, with -1 where a symbol went into the one before it.

    -1 in the input stands between words and is never merged.  Every word comes
    out as if it were merged by itself, always its lowest rank, then leftmost.
    """
    n = len(symbols)
    s = np.append(symbols, -1)  # the last place is the end, and the one before the first
    after, before = np.minimum(np.arange(1, n + 2), n), np.arange(-1, n)
    index = PairIndex()
    index.add(merges.ranks(s[:-1], s[1:]), np.arange(n))
    while index.active:
        r, i = index.lowest()
        left, right, new = merges.left[r], merges.right[r], merges.made[r]
        i = i[(s[i] == left) & (s[after[i]] == right)]  # others were merged since
        if left == right and len(i) > 1:  # of places that overlap every second one merges
            start = np.append(True, after[i[:-1]] != i[1:])
            run = np.maximum.accumulate(np.where(start, np.arange(len(i)), 0))
            i = i[(np.arange(len(i)) - run) % 2 == 0]
        if not len(i):
            continue
        j = after[i]
        s[i], s[j] = new, -1
        end = after[j]
        after[i], before[end] = end, i
        h = before[i]
        index.add(np.concatenate([merges.ranks(s[i], s[end]), merges.ranks(s[h], s[i])]), np.concatenate([i, h]))
    return s[:-1]


class PairIndexCoder:
    """Encodes and decodes texts for a lower-case vocabulary with word ends that drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        number = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = MergeTable(*(np.array([number[x] for x in column], dtype=np.int64) for column in (
            [a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges])))
        suffix = model["end_of_word_suffix"]
        shown = byte_symbols()
        self.inner, self.last = (np.array([number[c + end] for c in shown], dtype=np.int64) for end in ("", suffix))
        self.byte_of = {c: i for i, c in enumerate(shown)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # no word has letters and signs, as added tokens have, so that these can stand among words
        self.added = {k.encode(): np.array([v], dtype=IDS).tobytes() for k, v in added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        names = number | added
        self.names: list[str | None] = [None] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        library = Tokenizer.from_file(path)
        self.normalise, self.fall_apart = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.words = dict(self.added)

    def cut(self, text: str) -> list[bytes]:
        """The words of a text in order, as their normal form's bytes; an added token stands for itself."""
        if SIMPLE.fullmatch(text) and "<|" not in text:
            return WORDS.findall(text.lower().encode())
        out: list[bytes] = []
        for i, part in enumerate(self.split_added.split(text) if self.added else [text]):
            if i % 2:
                out.append(part.encode())
                continue
            for run in ASCII_SPACE.split(part):
                if SIMPLE.fullmatch(run):
                    out += WORDS.findall(run.lower().encode())
                else:  # the library's rules of characters, not its merges
                    out += [bytes(map(self.byte_of.__getitem__, w))
                            for w, _ in self.fall_apart(self.normalise(run))]
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit bytes, by one index over all of them."""
        if not words:
            return []
        raw = np.frombuffer(b"\0".join(words) + b"\0", dtype=np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        symbols[ends] = -1
        merged = apply_ranks(symbols, self.merges)
        live = merged >= 0
        flat = merged[live].astype(IDS).tobytes()
        edges = [0, *(4 * np.cumsum(live)[ends]).tolist()]
        return [flat[a:b] for a, b in zip(edges, edges[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the distinct words of all texts that are not kept from before make one index."""
        cut = [self.cut(text) for text in texts]
        own = set().union(*cut)
        new = list(own - self.words.keys())
        self.words.update(zip(new, self.encode_words(new)))
        out = [b"".join(map(self.words.__getitem__, words)) for words in cut]
        for word in new:
            if len(word) > LONGEST_WORD:
                del self.words[word]
        if len(self.words) > KEPT:
            self.words = self.added | {w: self.words[w] for w in own & self.words.keys()}
            if len(self.words) > KEPT:
                self.words = dict(self.added)
        return out

    def decode(self, ids: bytes) -> str:
        """The symbols' names with a space between them, as a vocabulary without a decoder has it; unknown ids give none."""
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(ids, dtype=IDS).tolist() if i < len(names) and names[i] is not None])


@functools.cache
def coder(path: str) -> PairIndexCoder:
    """One coder for each Python worker, kept from task to task."""
    return PairIndexCoder(path)


def code_documents(docs: DataFrame, path: str | None = None, decode: bool = True) -> DataFrame:
    """``docs`` with ``ids`` and ``n_tokens`` of its ``text`` and, with ``decode``, the text ``decoded`` from these ids.

    ``ids`` are little-endian unsigned 32-bit binary, without added begin or
    end; the strings of added tokens inside a text are those tokens.  Null and
    empty texts have no ids and decode to an empty text.  Columns of those
    names are replaced; all others pass through.  Every row is kept, repeated
    rows too.  ``path``: a vocabulary that every worker can open.  A worker
    hands on a portion of its texts at a time.
    """
    path = path or vocabulary("word_bpe_49k.json")
    new = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    new += [T.StructField("decoded", T.StringType())] if decode else []
    kept = docs.drop(*(f.name for f in new))
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            texts = batch.column(at).fill_null("")
            for low, high in portions(pc.binary_length(texts).to_pylist(), PORTION):
                ids = own.encode(texts.slice(low, high - low).to_pylist())
                columns = [pa.array(ids, pa.binary()), pa.array([len(x) // IDS.itemsize for x in ids], pa.int64())]
                if decode:
                    columns.append(pa.array(map(own.decode, ids), pa.string()))
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, *columns],
                                                 names=[*part.schema.names, *(f.name for f in new)])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *new]))


def decode_documents(coded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows with ``ids`` (see :func:`code_documents`) and the text ``decoded`` that they stand for; null: empty."""
    path = path or vocabulary("word_bpe_49k.json")

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = coder(path)
        for batch in batches:
            yield pa.array((own.decode(ids or b"") for ids in values(batch)), pa.string())

    return coded.withColumn("decoded", F.arrow_udf(decode, "string")("ids"))


def coding_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The query: token counts and digests of the ids and of the decoded text."""
    return code_documents(docs.select("doc_id", "text"), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
