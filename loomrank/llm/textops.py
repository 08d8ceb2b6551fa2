"""Vectorised word splitting and hashing over Arrow string columns.

Every operator that works on words calls these helpers inside ``mapInArrow``:
one pass over the UTF-8 bytes of a slice of documents, no Python loop over
words.  A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``.
Names of words and word sequences are 64-bit hashes, equal in every task: with
2**32 distinct names the chance of any false match is about one half, and for
two given different sequences it is about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACES = [0x20, *range(0x09, 0x0E)]
_BASE = 0x9E3779B97F4A7C15
#: bytes of text handled at once; one longer document is a slice of its own
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_table(fold: bool, outside: np.ndarray) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
    if fold:
        table[65:91] = table[97:123]
    table[outside] = 0
    return table


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[_SPACES] = True
#: ASCII bytes that are neither digit nor letter
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_OUTSIDE = {"spaces": _IS_SPACE, "marks": _IS_MARK}
_TABLES = {(fold, kind): _byte_table(fold, outside) for fold in (False, True) for kind, outside in _OUTSIDE.items()}
_POWERS = np.array([pow(_BASE, i, 1 << 64) for i in range(4096)], dtype=U)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        step = U(pow(_BASE, len(_POWERS), 1 << 64))
        _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS


@dataclass
class Words:
    """Words of a slice of documents: ``first[d]:first[d+1]`` are those of document d."""

    data: np.ndarray  # UTF-8 bytes of the slice
    starts: np.ndarray  # byte offsets of words
    ends: np.ndarray
    first: np.ndarray  # index of each document's first word, and the total
    names: np.ndarray  # 64-bit name of each word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of rows of about ``size`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False, outside: str = "spaces") -> Words:
    """Split a slice into words; ``fold`` lower-cases A-Z in names.

    Words end at ``spaces``, or at all ASCII ``marks``: what is neither digit nor letter.
    """
    inside = ~_OUTSIDE[outside][data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offsets)
    if len(starts):
        place = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
        value = _TABLES[fold, outside][data]
        value *= _powers(int(place.max()) + 1)[place]
        names = mix(np.add.reduceat(value, starts) ^ (ends - starts).astype(U))
    else:
        names = np.zeros(0, U)
    return Words(data, starts, ends, first, names)


_STEPS = mix(np.arange(101, 165, dtype=U)) | U(1)


def ngrams(names: np.ndarray, n: int) -> np.ndarray:
    """Names of all runs of n consecutive names, wherever documents end."""
    if len(names) < n:
        return np.zeros(0, U)
    total = np.zeros(len(names) - n + 1, U)
    for i in range(n):
        total += names[i : len(names) - n + 1 + i] * _STEPS[i]
    return mix(total)


def sequence_name(names: np.ndarray) -> int:
    """Name of a whole sequence of names, its length included."""
    h = U(len(names))
    if len(names):
        h = np.bitwise_xor.reduce(mix(names + mix(np.arange(len(names), dtype=U)))) ^ mix(np.array([h]))[0]
    return int(mix(np.array([h], dtype=U))[0])


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each document, sorted: ``(names, bounds)``.

    A document of fewer than n words has its whole sequence as its one shingle;
    a document without words has none.
    """
    counts = w.counts
    doc = w.doc_of_word()
    grams = ngrams(w.names, n)
    owner = doc[: len(grams)]
    whole = owner == doc[n - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[whole], owner[whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.array([sequence_name(w.names[w.first[d] : w.first[d + 1]]) for d in short], dtype=U)
        grams, owner = np.concatenate([grams, extra]), np.concatenate([owner, short])
    bounds = np.searchsorted(np.sort(owner), np.arange(len(counts) + 1))
    if len(short):
        order = np.argsort(owner, kind="stable")
        grams = grams[order]
    out, sizes = [], []
    for d in range(len(counts)):
        own = np.unique(grams[bounds[d] : bounds[d + 1]])
        out.append(own)
        sizes.append(len(own))
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
