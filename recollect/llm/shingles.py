"""Vectorised word shingles and MinHash signatures over the bytes of a batch of texts.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A text's set holds the
distinct 64-bit hashes of its runs of k words; with fewer words, the whole sequence counts as one shingle;
without words, the set is empty.
"""

from __future__ import annotations

import numpy as np

from .common import chunks

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DRAWS = np.random.default_rng(20240229)
_BYTE = _DRAWS.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _DRAWS.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes about half of the output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 20), base, np.uint64)
        out[0] = 1
        have = np.cumprod(out, dtype=np.uint64)
        if n <= 8 << 20:  # tables for one exceptionally long text are not kept
            _POWERS[base] = have
    return have[:n]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of symbols[t] * base ** t for i <= t < j."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(_BASE, len(symbols)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(_BASE_INVERSE, len(prefix))[start]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and the offsets of each row's words."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = ~_SPACE[data]
    after_gap = np.ones(n, bool)
    after_gap[1:] = ~solid[:-1]
    before_gap = np.ones(n, bool)
    before_gap[:-1] = ~solid[1:]
    start = np.flatnonzero(solid & (after_gap | edge[:-1]))
    end = np.flatnonzero(solid & (before_gap | edge[1:])) + 1
    hashes = mix(range_hash(prefix_hash(_BYTE[_LOWER[data]]), start, end) + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles in order (repeats stay), and their offsets."""
    counts = np.diff(offsets)
    per_row = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_offsets = np.zeros(len(offsets), np.int64)
    np.cumsum(per_row, out=out_offsets[1:])
    out = np.zeros(out_offsets[-1], np.uint64)
    n = len(hashes)
    if n >= k:
        full = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            full += hashes[j : n - k + 1 + j] * _STEP[j]
        inside = np.repeat(counts >= k, counts)[: n - k + 1] & (np.arange(n - k + 1) + k <= np.repeat(offsets[1:], counts)[: n - k + 1])
        out[np.repeat(counts >= k, per_row)] = mix(full[inside] + _U(k))
    for size in range(1, k):
        rows = np.flatnonzero(counts == size)
        if len(rows):
            total = np.zeros(len(rows), np.uint64)
            for j in range(size):
                total += hashes[offsets[rows] + j] * _STEP[j]
            out[out_offsets[rows]] = mix(total + _U(size))
    return out, out_offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted, once each."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    out = np.zeros(len(offsets), np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return np.concatenate(parts) if parts else values[:0], out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """Yields (first row, last row, values, offsets) for chunks of rows; every byte of every row is read."""
    for a, b in chunks(offsets):
        own = offsets[a : b + 1] - offsets[a]
        values, at = distinct(*shingles(*words(data[offsets[a] : offsets[b]], own), k))
        yield a, b, values, at


def minhash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.default_rng(97)
    return draws.integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1), draws.integers(0, 2**63, n, dtype=np.uint64)


def minhash(values: np.ndarray, offsets: np.ndarray, family) -> np.ndarray:
    """One row of 32-bit minima for each non-empty row, in order."""
    a, b = family
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(a), len(starts)), np.uint32)
    for i in range(len(a)):
        if len(starts):
            out[i] = np.minimum.reduceat(values * a[i] + b[i], starts) >> _U(32)
    return np.ascontiguousarray(out.T)


def set_digest(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests for each row; equal sets have equal digests, (0, 0) for the empty set."""
    one, two = np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values + _U(0xA5A5)), out=one[1:])
    np.cumsum(mix(values ^ _U(0x5BD1E9955BD1E995)), out=two[1:])
    return (one[offsets[1:]] - one[offsets[:-1]]).view(np.int64), (two[offsets[1:]] - two[offsets[:-1]]).view(np.int64)
