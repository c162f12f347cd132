"""Words of many texts at once, as 64-bit hashes, in numpy.

Texts are laid one after another in a byte array. A table says which bytes belong to words; every byte
from 0x80 on does, so UTF-8 needs no decoding. A word's hash is a polynomial in its bytes (A-Z lowered)
modulo 2**64, from differences of one running sum, then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.Generator(np.random.Philox(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_ODD = _RNG.integers(1, 2**63, 64, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = 0x0A
CHUNK_BYTES = 1 << 20

SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_POWERS = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def _powers(n: int, inverse: bool) -> np.ndarray:
    have = _POWERS[inverse]
    if len(have) < n:
        step = np.full(max(n, CHUNK_BYTES + 1024), _INVERSE if inverse else _BASE, np.uint64)
        step[0] = 1
        have = _POWERS[inverse] = np.cumprod(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a chunk of texts: `bounds[i]:bounds[i + 1]` are those of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span."""
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(len(data), False), out=running[1:])
    return mix((running[ends] - running[starts]) * _powers(len(data) + 1, True)[starts])


def words_of(texts: list[bytes], kind: np.ndarray) -> Words:
    data = LOWER[np.frombuffer(bytes([SEPARATOR]).join([*texts, b""]), np.uint8)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = kind[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    hashes = spans_hash(data, starts, ends)
    text_ends = np.cumsum(sizes)
    bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    return Words(data, starts, ends, hashes, bounds)


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word; n - 1 fewer than words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, np.uint64(n * 0x632BE59BD9B4E019 % 2**64))
    for j in range(n):
        total += hashes[j : j + count] * _ODD[j % len(_ODD)] if n <= len(_ODD) else mix(hashes[j : j + count] + np.uint64(j))
    return mix(total)


def chunks(sizes: list[int], limit: int = CHUNK_BYTES):
    """Slices of consecutive texts of at most `limit` bytes together; a longer text stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))
