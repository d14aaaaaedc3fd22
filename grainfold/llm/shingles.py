"""Word shingles as 64-bit values, computed over whole texts with numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A shingle is a run of
words joined by single spaces, hashed by a polynomial over its bytes (random
value per byte, odd base, modulo 2**64) and mixed; prefix sums give every
shingle of a text at once.  Different shingles share a value with a chance of
about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20261).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << n.bit_length()
        with np.errstate(over="ignore"):
            for base, name in ((_BASE, "_pow"), (pow(_BASE, -1, 2**64), "_inv")):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                globals()[name] = np.cumprod(a, dtype=np.uint64)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits (the 64-bit finalizer of MurmurHash3)."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def runs(text: str | None, words: int = WORDS) -> np.ndarray:
    """The shingle value at each word position that has one; a text of fewer words has one, of all its words."""
    b = b" ".join((text or "").encode().lower().split())
    if not b:
        return np.empty(0, np.uint64)
    a = np.frombuffer(b, np.uint8)
    up, down = _powers(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTES[a] * up[: len(a)], out=sums[1:])
    gaps = np.flatnonzero(a == 32)
    starts = np.concatenate(([0], gaps + 1))
    k = min(words, len(starts))
    ends = np.concatenate((gaps, [len(a)]))[k - 1 :]
    starts = starts[: len(ends)]
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingle values, ascending."""
    h = runs(text, words)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit values that name a set of shingle values (128 bits; equal sets, equal names)."""
    if not len(s):
        return 0, 0
    a = int(np.bitwise_xor.reduce(mix(s + _U(0x1234567)))) ^ len(s)
    b = int(np.add.reduce(mix(s ^ _U(0x5BF0_3635_DEAD_BEEF)), dtype=np.uint64))
    return a - (a >> 63 << 64), b - (b >> 63 << 64)
