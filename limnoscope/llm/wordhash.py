"""Hashes of all words of an Arrow batch of texts at once.

A prefix sum of `byte * P**position` modulo 2**64 over the texts' joined bytes gives every word's polynomial by one
subtraction; multiplying with the inverse power of its start makes it independent of its place. No word becomes a
Python object.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are worked on in slices of about so many bytes; a longer text is one slice.
SLICE_BYTES = 2_000_000


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power_table(base: int, size: int) -> np.ndarray:
    return _powers(base, 1 << max(21, int(size).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _fold() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


FOLD = _fold()  # lower-cases A-Z
#: Bytes of words between white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words of letters, digits and anything beyond ASCII.
ALPHANUMERIC = np.array([chr(i).isalnum() or i >= 128 for i in range(256)])


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    _, offs, data = texts.buffers()
    if n == 0 or data is None:
        if n:
            yield 0, n, np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
        return
    offsets = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of each lower-cased word, and each text's first word index (one more at the end)."""
    size = len(data)
    if size > 2 * SLICE_BYTES and len(offsets) == 2:
        return _in_pieces(data, within)
    if size == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64)
    inside = np.zeros(size + 2, dtype=bool)
    inside[1:-1] = within[data]
    before, after = inside[:-2].copy(), inside[2:].copy()
    # A text's edge ends a word.
    edges = offsets[(offsets > 0) & (offsets < size)]
    before[edges] = False
    after[edges - 1] = False
    body = inside[1:-1]
    start, end = np.flatnonzero(body & ~before), np.flatnonzero(body & ~after) + 1
    total = np.zeros(size + 1, dtype=U)
    np.cumsum(FOLD[data].astype(U) * _power_table(BASE, size)[:size], out=total[1:])
    h = (total[end] - total[start]) * _power_table(INVERSE, size)[start]
    return mix(h + (end - start).astype(U)), start, end, np.searchsorted(start, offsets)


def _in_pieces(data: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One very long text, piece by piece between words, so working memory stays that of a slice."""
    found, at = [], 0
    while at < len(data):
        end = at + SLICE_BYTES
        while end < len(data) and within[data[end]]:
            # Up to the end of the word that lies across.
            gap = np.flatnonzero(~within[data[end : end + 4096]])
            end += int(gap[0]) if len(gap) else 4096
        end = min(end, len(data))
        h, start, stop, _ = word_hashes(data[at:end], np.array([0, end - at, end - at]), within)
        found.append((h, start + at, stop + at))
        at = end
    h, start, stop = (np.concatenate(x) for x in zip(*found))
    return h, start, stop, np.array([0, len(h)])


def grams(h: np.ndarray, first: np.ndarray, size: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of each run of `size` words within one text; with `skip`, of two words so far apart."""
    reach = size - 1 + skip
    if len(h) <= reach:
        return np.zeros(0, U), np.zeros(0, np.int64)
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(h)) + reach < last)
    out = mix(h[at] + U(1009 * (skip + 1)))
    for k in [reach] if skip else range(1, size):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[at + k])
    return out, at


def word_hash(word: str) -> int:
    """Hash of one word, as `word_hashes` gives it."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(word_hashes(data, np.array([0, len(data)]), np.ones(256, dtype=bool))[0][0])
