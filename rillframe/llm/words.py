"""Words of texts and hashes of runs of words, for many texts at a time."""

from __future__ import annotations

import numpy as np

from rillframe.llm.common import mixed

#: Bytes handled at a time: small enough for the arrays to stay in a processor's cache.
AT_ONCE = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SAME = mixed(np.arange(1, 257, dtype=np.uint64))
_LOWER = _SAME.copy()
_LOWER[65:91] = _SAME[97:123]
_STEP = np.uint64(0xA24BAED4963EE407)
_RUN = np.uint64(0x9FB21C651E98DF25)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_STEP, 256)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, byte at which it starts, offsets of texts among words). Words are runs of bytes other than ASCII white space."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    seen = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(first, out=seen[1:])
    if not len(starts):
        return np.zeros(0, np.uint64), starts, seen[offsets]
    at = np.flatnonzero(solid)
    begin = np.searchsorted(at, starts)
    size = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, size)
    powers = _POWERS if size.max() <= len(_POWERS) else _powers(_STEP, int(size.max()))
    value = (_LOWER if lower else _SAME)[raw[at]] * powers[place]
    return mixed(np.add.reduceat(value, begin) + size.astype(np.uint64)), starts, seen[offsets]


def powers_and_inverses(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and what undoes them."""
    return _powers(_RUN, n), _powers(np.uint64(pow(int(_RUN), -1, 1 << 64)), n)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k words on end; the caller leaves out those that span texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = words[k - 1 :].copy()
        for j in range(k - 2, -1, -1):
            out *= _RUN
            out += words[j : j + n]
        return mixed(out)
    # sums of words times powers, divided by the power at the start (its inverse modulo 2**64)
    powers, inverse = powers_and_inverses(len(words))
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers, out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * inverse[:n])
