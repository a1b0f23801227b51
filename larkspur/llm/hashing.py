"""Vectorised hashes of substrings: one running sum per buffer gives every span's hash.

A span s..e of bytes b hashes to sum(T[b_j] * B**(j - s)) modulo 2**64 with a random table T and
an odd base B; with prefix sums that is (P[e] - P[s]) * B**-s.
"""

from __future__ import annotations

import numpy as np

from .common import SPACE, groups_of, text_view

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
TABLE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256)
LOWER[65:91] += 32
LOWER_TABLE = TABLE[LOWER]
#: Bytes looked at together; bounds the temporary arrays.
PIECE = 1 << 18

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept for the worker's life and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def prefix(raw: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * powers(BASE, len(raw)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * powers(INVERSE, len(sums))[start]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def words(column, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, hash of each word with A-Z lowered) over whole texts, in text order.

    Texts are taken in pieces of about PIECE bytes; a longer text is cut at a separator, so no
    word is split.
    """
    raw, at = text_view(column)
    rows, hashes = [], []
    for first, last in groups_of(at, PIECE):
        a, stop = int(at[first]), int(at[last])
        while a < stop:
            b = stop
            if stop - a > 2 * PIECE:  # a single long text
                gaps = np.flatnonzero(separator[raw[a + PIECE : stop]])
                b = a + PIECE + int(gaps[0]) if len(gaps) else stop
            part = raw[a:b]
            solid = ~separator[part]
            starts = np.empty(len(part), bool)
            starts[0] = True
            np.logical_not(solid[:-1], out=starts[1:])
            edges = at[first:last] - a
            starts[edges[(edges >= 0) & (edges < len(part))]] = True
            ends = np.empty(len(part), bool)
            ends[-1] = True
            ends[:-1] = ~solid[1:] | starts[1:]
            s, e = np.flatnonzero(starts & solid), np.flatnonzero(ends & solid) + 1
            if len(s):
                hashes.append(mix(span_hash(prefix(part, LOWER_TABLE), s, e) + (e - s).astype(np.uint64)))
                rows.append(np.searchsorted(at, s + a, side="right").astype(np.int64) - 1)
            a = b
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)
