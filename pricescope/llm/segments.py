"""Words and lines of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1


def _mixed(x: int) -> int:
    """SplitMix64's finaliser."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit number for every byte, and for every byte with A to Z as a to z.
BYTE_CODES = np.array([_mixed(b) for b in range(256)], np.uint64)
LOWER_CODES = np.array([_mixed(b + 32 if 65 <= b <= 90 else b) for b in range(256)], np.uint64)
_BASE = np.uint64(_mixed(1000) | 1)

#: Space and \t \n \v \f \r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def multipliers(n: int) -> np.ndarray:
    """Odd random numbers, one for each place."""
    return np.array([_mixed(5000 + i) | 1 for i in range(n)], np.uint64)


def hash_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """A 64-bit hash of each run of bytes (a polynomial in its bytes' codes, then mixed); 0 for an empty run."""
    out = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(lengths > 0)
    if not len(full):
        return out
    n = lengths[full]
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    power = np.full(int(n.max()), _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    terms = codes[data[place + np.repeat(starts[full], n)]] * power[place]
    out[full] = mix(np.add.reduceat(terms, first) + n.astype(np.uint64))
    return out


def find_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word (a run without separators inside one text), and each text's first word (n + 1)."""
    space = separators[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = ~space[inner]
    stops = ~space
    stops[:-1] &= space[1:]
    stops[inner - 1] = ~space[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1 - starts, np.searchsorted(starts, offsets)


def find_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every line, and each text's first line (n + 1). A text has one line more than it has newlines."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    counts = np.bincount(owner, minlength=n) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    starts = np.empty(int(first[-1]), np.int64)
    ends = np.empty_like(starts)
    place = np.arange(len(breaks)) + owner
    starts[first[:-1]] = offsets[:-1]
    ends[first[1:] - 1] = offsets[1:]
    starts[place + 1] = breaks + 1
    ends[place] = breaks
    return starts, ends - starts, first
