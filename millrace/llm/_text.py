"""Words of UTF-8 texts and hashes of them, for whole blocks of texts at once.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D. Its hash is of 64 bits and depends on its bytes alone.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Whatever is neither an ASCII letter nor of a longer character.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_STEP, _BACK = 0x9E3779B97F4A7C13, pow(0x9E3779B97F4A7C13, -1, 1 << 64)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse, n at least."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_STEP, _BACK)):
            _POWERS[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))])
    return _POWERS


class Words:
    """The words of texts: where they begin and end in `buffer`, their hashes, and `first`, the first word of each text.

    between: a table of the bytes that are no part of a word; it holds the line feed.
    """

    def __init__(self, texts: list[bytes], lower: bool = True, hashes: bool = True, between: np.ndarray = SPACE) -> None:
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.concatenate([[0], np.cumsum(lengths + 1)])  # of each text in the buffer
        self.buffer = LOWER[joined] if lower else joined
        inside = ~between[joined]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.offset)
        if hashes:
            up, _ = _powers(len(joined) + 1)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[self.buffer] * up[: len(joined)])])
            self.hash = self.hashed(self.end)

    def hashed(self, end: np.ndarray) -> np.ndarray:
        """Hashes of what lies from each word's start to `end`."""
        length = (end - self.start).astype(np.uint64)
        return mixed((self.sums[end] - self.sums[self.start]) * _POWERS[1][self.start] + length * _U(0xD6E8FEB86659FD93))


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every `size` successive hashes of h: max(0, len(h) - size + 1) of them."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size if n else 0):
        out = out * _U(_STEP) + h[k : k + n]
    return mixed(out + _U(size))


def prefix_sums(h: np.ndarray) -> np.ndarray:
    """What span_hash needs of h."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(len(h) + 1)[0][: len(h)])])


def span_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the spans [a, b) of what prefix_sums was of; equal for equal contents."""
    return mixed((sums[b] - sums[a]) * _powers(len(sums))[1][a] + (b - a).astype(np.uint64) * _U(0xA24BAED4963EE407))
