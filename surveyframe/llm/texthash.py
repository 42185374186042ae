"""Hashes of words and of byte strings for whole slabs of text at a time.

A string b_0 .. b_m hashes to a mix of sum(TABLE[b_j] * BASE**j) modulo 2**64 and of
its length, so the hash of any part of a slab follows from running sums.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
TABLE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = TABLE.copy()
LOWER[65:91] = TABLE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U = np.uint64

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE**0 .. BASE**(n-1) and their inverses."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def sums(buf: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """Running sums from which ``span`` makes hashes."""
    return running(table[buf])


def running(values: np.ndarray) -> np.ndarray:
    """``sums`` over a value for each symbol."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings buf[start:end]."""
    raw = (run[end] - run[start]) * powers(len(run))[1][start]
    return mix(raw + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, bounds: np.ndarray, limit: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (ASCII letters lower-cased) and each text's bounds among them."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    space = SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([True], space[:-1]))
    after = np.concatenate((space[1:], [True]))
    start = np.flatnonzero(~space & (edge[:-1] | before))
    end = np.flatnonzero(~space & (edge[1:] | after)) + 1
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):  # in steps, since a single text may be very long
        to = max(at + 1, int(np.searchsorted(end, start[at] + limit, "right")))
        base = start[at]
        out[at:to] = span(sums(buf[base : end[to - 1]], LOWER), start[at:to] - base, end[at:to] - base)
        at = to
    return out, np.searchsorted(start, bounds)


def shingles(buf: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's sorted set of hashed word shingles; with fewer words, all of them as one."""
    w, at = words(buf, bounds)
    a = U(0xC2B2AE3D27D4EB4F)
    m = max(0, len(w) - size + 1)
    s = np.zeros(m, np.uint64)
    for k in range(size):
        s = s * a + w[k : k + m]
    s = mix(s)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(s[lo : hi - size + 1]))
        elif hi > lo:
            few = np.full(1, hi - lo, np.uint64)
            for x in w[lo:hi]:
                few = mix(few * a + x)
            out.append(few)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
