"""Word-shingle sets of texts as sorted 64-bit hashes, made column-wise on the UTF-8 bytes of a batch."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from fairlead.llm.common import text_buffer

#: Bytes hashed at once.
CHUNK = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_PLACES = _RNG.integers(0, 1 << 64, 8, np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(0, 1 << 64, dtype=np.uint64)) | 1
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(20, size.bit_length()))
    return up[:size], down[:size]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and how many words lie before each document (n + 1 numbers)."""
    filled = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(filled & (np.concatenate([[True], ~filled[:-1]])[: len(data)] | edge[:-1]))
    ends = np.flatnonzero(filled & (np.concatenate([~filled[1:], [True]])[: len(data)] | edge[1:])) + 1
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:-1], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def document_sets(column: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes in ascending order (uint64)."""
    data, offsets = text_buffer(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        hashes, before = word_hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words):
            rolled += hashes[k : len(hashes) - words + 1 + k] * _PLACES[k] if len(rolled) else rolled
        rolled = mix(rolled)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            else:  # fewer words: the whole sequence is one shingle
                yield mix(np.array([(hashes[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)) if b > a else np.zeros(0, np.uint64)
        at = to


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set: a hash of its members and their number."""
    total = mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(mix(np.array([total], np.uint64)).astype(np.int64)[0])
