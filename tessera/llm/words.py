"""Hashes of the words of many texts at once.

Words are runs of bytes other than ASCII white space, with A-Z in lower case.
A column's texts are read as one array of bytes: every step is an array
operation over all words of the column, none a loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
LONGEST = 256
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: The first k bytes of eight, by k.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * MULTIPLIER
    return values ^ (values >> np.uint64(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, one text after another, and their edges."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[edges[0]:edges[-1]], edges - edges[0]


def words_of(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts between ``edges``, in order, and how many words each text has.

    A word's hash takes in its length and then eight bytes at a time; words of
    up to eight bytes and the same length never have the same one.
    """
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    heads = edges[:-1][edges[:-1] < edges[1:]]  # of texts that are not empty; a word stops at a text's end
    tails = edges[1:][edges[:-1] < edges[1:]] - 1
    begins[heads], ends[tails] = inside[heads], inside[tails]
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - starts
    lower = np.concatenate([LOWER[data], np.zeros(8, dtype=np.uint8)])
    lanes = np.ndarray(len(data) + 1, dtype="<u8", buffer=lower, strides=(1,))
    out = sizes.astype(np.uint64) * MULTIPLIER
    short = np.minimum(sizes, LONGEST)
    for done in range(0, int(short.max(initial=0)), 8):
        at = np.flatnonzero(short > done)
        out[at] = mixed(out[at] + (lanes[starts[at] + done] & FIRST_BYTES[np.minimum(short[at] - done, 8)]))
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        out[i] = xxhash.xxh3_64_intdigest(lower[starts[i]:starts[i] + sizes[i]])
    return out, np.diff(np.searchsorted(starts, edges))
