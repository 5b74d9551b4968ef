"""Word shingles of a text as sorted 62-bit hashes, computed a block of bytes at a time."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_BLOCK = 1 << 16
_WRAP = 1 << 64
_RNG = np.random.Generator(np.random.PCG64(20240817))
_BYTE = _RNG.integers(0, _WRAP, 256, np.uint64, endpoint=False)
_PLACE = _RNG.integers(0, _WRAP, 16, np.uint64, endpoint=False) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, _WRAP)


def _powers(base: int) -> np.ndarray:
    out = np.empty(_BLOCK, np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_POWERS, _BACK = _powers(_BASE), _powers(_UNDO)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word of the text with A-Z in lower case, in order.

    A word's hash is a polynomial of its bytes, read off running sums over blocks, so long
    texts and long words need no more memory than short ones besides their boundaries.
    """
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    raw = np.frombuffer(data, np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = _BLANK[raw]
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = turns[::2], turns[1::2]
    sums = np.empty(len(turns), np.uint64)
    back = np.empty(len(starts), np.uint64)
    carry = np.uint64(0)
    for low in range(0, max(1, len(raw)), _BLOCK):
        part = raw[low : low + _BLOCK]
        scale = np.uint64(pow(_BASE, low, _WRAP))
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POWERS[: len(part)], out=run[1:])
        a, b = np.searchsorted(turns, [low, low + _BLOCK])
        sums[a:b] = run[turns[a:b] - low] * scale + carry
        a, b = np.searchsorted(starts, [low, low + _BLOCK])
        back[a:b] = _BACK[starts[a:b] - low] * np.uint64(pow(_UNDO, low, _WRAP))
        with np.errstate(over="ignore"):
            carry = carry + run[-1] * scale
    if len(turns) and turns[-1] == len(raw) and len(raw) % _BLOCK == 0:
        sums[-1] = carry
    size = (ends - starts).astype(np.uint64)
    return mixed((sums[1::2] - sums[::2]) * back + size * np.uint64(_UNDO))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles, sorted. A text of fewer words has its whole sequence as
    the only one, a text without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(k, len(w))
    total = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        total += w[j : len(w) - n + 1 + j] * _PLACE[j]
    return np.unique(mixed(total) >> np.uint64(2))
