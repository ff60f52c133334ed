"""Polynomial hashes of byte strings, for whole arrays of windows at once.

prefix[i] is the hash of the first i bytes modulo 2^64; with the powers of an odd base and their
inverses the hash of any window follows from two prefixes. Bytes go through a table of random numbers
first, and window hashes through a finaliser, so that single bits are usable.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and base^-0.., n of each at least."""
    if len(_powers["up"]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for key, b in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def prefixes(raw: np.ndarray) -> np.ndarray:
    """raw: bytes as uint8. n + 1 prefix hashes."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(TABLE[raw] * up[: len(raw)], out=out[1:])
    return out


def windows(prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hashes of raw[start:end] for arrays of starts and ends (or equal-length slices of the positions)."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start if isinstance(start, np.ndarray) else start])


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of raw, split at ASCII white space."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return start, windows(prefixes(raw), start, end) if len(start) else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of `size` words; of all words as one run if there are fewer."""
    n = min(size, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = out * BASE + words[j : len(words) - n + 1 + j]
    return mix(out + np.uint64(n))
