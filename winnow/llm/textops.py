"""Vectorised hashing of words, shingles and substrings of one text's bytes."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True  # words are runs of other bytes

BASES = [BASE, U(0xD1B54A32D192ED03)]  # of two independent hashes
_POWERS = [[np.ones(1, U), np.ones(1, U)] for _ in BASES]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64, up to n at least."""
    held = _POWERS[which]
    if len(held[0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        inverse = U(pow(int(BASES[which]), -1, 1 << 64))
        for k, b in ((0, BASES[which]), (1, inverse)):
            steps = np.full(size, b, U)
            steps[0] = U(1)
            held[k] = np.cumprod(steps, dtype=U)
    return held[0], held[1]


def prefix_sums(raw: np.ndarray, which: int = 0) -> np.ndarray:
    """P with P[j] - P[i] the (shifted) polynomial hash of raw[i:j]."""
    out = np.zeros(len(raw) + 1, U)
    # bytes are spread over 64 bits first, so that short strings differ in all of them
    np.cumsum(_SPREAD[which][raw] * powers(len(raw), which)[0][: len(raw)], out=out[1:], dtype=U)
    return out


_SPREAD = [mix(np.arange(1, 257, dtype=U) * c) for c in (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))]


def span_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the substrings [lo, hi); sums are of the same base."""
    inv = powers(len(sums), which)[1]
    return mix((sums[hi] - sums[lo]) * inv[lo] + (hi - lo).astype(U) * U(0xA24BAED4963EE407))


def word_hashes(raw: np.ndarray) -> np.ndarray:
    blank = np.concatenate(([True], SPACE[raw], [True]))
    lo = np.flatnonzero(blank[:-1] & ~blank[1:])
    hi = np.flatnonzero(~blank[:-1] & blank[1:])
    return span_hash(prefix_sums(raw), lo, hi) if len(lo) else np.zeros(0, U)


def shingles(raw: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; of all words if there are fewer."""
    w = word_hashes(raw)
    if not len(w):
        return w
    width = min(width, len(w))
    n = len(w) - width + 1
    out = np.full(n, U(width))
    for k in range(width):
        out = mix(out * BASE + w[k : k + n])
    return out


def content_key(data: bytes) -> tuple[int, int]:
    """128 bits of a text's word sequence, as two signed 64-bit integers."""
    x = xxhash.xxh3_128_intdigest(b" ".join(data.split()))
    return ((x >> 64) ^ (1 << 63)) - (1 << 63), ((x & (1 << 64) - 1) ^ (1 << 63)) - (1 << 63)


def fresh(name: str, columns: list[str]) -> str:
    """name, with as many marks as keep it off the given columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
