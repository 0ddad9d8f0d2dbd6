"""Hashes of words and word shingles of whole texts, computed on arrays of bytes.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z is lower-cased; texts are UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64
_PRIME, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd multipliers


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_PRIME))
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, _U), np.ones(1, _U)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate((np.ones(1, _U), np.full(n - 1, m, _U)))) for m in (_PRIME, pow(_PRIME, -1, 1 << 64)))
    return _powers


def word_hashes(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first byte and end of each word of one text."""
    if not text:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(text.translate(_LOWER), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _BREAK[data], [True])).view(np.int8)))
    begin, end = edges[::2], edges[1::2]
    up, down = _power(len(data) + 1)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[data] * up[: len(data)])))
    return mix((sums[end] - sums[begin]) * down[begin]), begin, end


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``size`` words in a row; of fewer words, the whole sequence as one."""
    if not len(words):
        return np.zeros(0, _U)
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, _U)
    for k in range(size):
        total = total * _U(_STEP) + words[k : len(words) - size + 1 + k]
    return np.unique(mix(total))
