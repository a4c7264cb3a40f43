"""Hashes of all words of a batch of texts at once, in numpy.

A word's hash is a polynomial of its bytes modulo 2**64, with random coefficients for the bytes, then mixed. Equal
words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: Bytes of text that are hashed at once; each takes some 100 bytes of memory meanwhile. One longer text goes alone.
CHUNK_BYTES = 1 << 20

_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_RNG = np.random.Generator(np.random.PCG64(20_240_601))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
#: Coefficients for the places of a word in a sequence.
PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)
_BASE = int(_RNG.integers(1, 2**63, dtype=np.uint64)) | 1


def _lowered() -> np.ndarray:
    table = _BYTE.copy()
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


def white_space_words() -> np.ndarray:
    """Words are what stands between ASCII white space; A-Z count as a-z."""
    table = _lowered()
    table[list(_WHITE)] = 0
    return table


def plain_words() -> np.ndarray:
    """Words are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z."""
    table = _lowered()
    table[[b for b in range(128) if not chr(b).isalnum()]] = 0
    return table


def lines() -> np.ndarray:
    """Words are lines, of whatever bytes but line feeds."""
    table = _BYTE.copy()
    table[ord("\n")] = 0
    return table


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers in which every bit depends on every other."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, U64), np.full(size, pow(_BASE, -1, 2**64), U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and where each value begins, and the end."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end
        at = end


def hashed(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order; where each text's words begin, and the end; where each word's bytes begin."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    values = table[data]
    inside = values != 0
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64), starts
    up, down = _powers(1 << max(16, int(n - 1).bit_length()))
    values *= up[:n]
    words = mixed(np.add.reduceat(values, starts) * down[starts])
    return words, np.searchsorted(starts, offsets), starts


def shingled(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words, or of all its words if fewer, and where each text's begin.

    Texts without words have none. Repeats are still in.
    """
    counts = np.diff(bounds)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begins = np.concatenate(([0], np.cumsum(runs)))
    # The first word of each run: a text's first word, and on by one.
    first = np.repeat(bounds[:-1] - begins[:-1], runs) + np.arange(begins[-1])
    padded = np.concatenate((words, np.zeros(size, U64)))
    total = np.zeros(len(first), U64)
    short = np.repeat(np.where(counts < size, counts, size), runs)
    for place in range(size):
        part = padded[first + place] * PLACE[place]
        total += np.where(place < short, part, U64(0))
    return mixed(total + short.astype(U64) * PLACE[63]), begins
