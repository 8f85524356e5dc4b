"""Words of a text as an array of 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from functools import cache

import numpy as np

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)


@cache
def _alphanumeric() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


_power, _inverse = np.ones(1, U), np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = 1 << (n - 1).bit_length()
        back = U(pow(int(_STEP), -1, 1 << 64))
        for_step, for_back = np.full(size, _STEP, U), np.full(size, back, U)
        for_step[0] = for_back[0] = 1
        _power, _inverse = np.multiply.accumulate(for_step), np.multiply.accumulate(for_back)
    return _power, _inverse


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the maximal runs of letters and digits of the lower-cased text, in order."""
    if not text:
        return np.empty(0, U)
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _alphanumeric()[chars]
    if not inside.any():
        return np.empty(0, U)
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    power, inverse = _powers(len(chars))
    terms = (chars.astype(U) + U(1)) * power[: len(chars)] * inside
    return mixed(np.add.reduceat(terms, starts) * inverse[starts])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words."""
    if len(hashes) < n:
        return np.empty(0, U)
    size = len(hashes) - n + 1
    out = np.zeros(size, U)
    for k in range(n):
        out = out * _STEP + hashes[k : k + size]
    return mixed(out)
