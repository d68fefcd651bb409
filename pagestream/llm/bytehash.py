"""64-bit fingerprints of byte spans from one prefix sum, and hashes of words and word shingles.

A text's prefix sums of table[byte] * BASE**i (mod 2**64) give the fingerprint of any span [s, e) by one
subtraction and one product with BASE**-s, so equal spans have equal fingerprints wherever they stand.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_powers = np.ones(1, U)
_inverses = np.ones(1, U)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(1 << 16, 2 * n)
        for name, base in (("_powers", BASE), ("_inverses", BASE_INVERSE)):
            steps = np.full(size, U(base))
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a uint8 array; one entry more than it has bytes."""
    _grow(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(TABLE[data] * _powers[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the spans [start, end)."""
    return mix((sums[end] - sums[start]) * _inverses[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


#: Sums mod 2**64 of texts this long can be made equal on purpose, so longer words get BLAKE2b.
LONG_WORD = 64


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a text, A-Z lower-cased, in order (separators are ASCII)."""
    data = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)  # bytes.lower knows ASCII only
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data != 32) & (data - np.uint8(9) > 4)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    out = spans(prefix(data), start, end)
    for i in np.flatnonzero(end - start > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_hashes(word: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the word shingles in order; a shorter text gives one of all its words, none gives none."""
    if not len(word):
        return word
    size = min(size, len(word))
    n = len(word) - size + 1
    out = word[:n] + U(size)
    for i in range(1, size):
        out = out * U(BASE) + word[i : i + n]
    return mix(out)
