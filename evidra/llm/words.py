"""Words of many texts at once: a batch's bytes are scanned as one array, and each word gets a 64-bit
hash from one prefix sum, so no Python object is made per word."""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] in lower-cased text, before lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of [^\x20\x09-\x0D].
SOLID = np.ones(256, bool)
SOLID[[0x20, 9, 10, 11, 12, 13]] = False

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**i modulo 2**64 for i below n, kept for the next call."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        size = -(-n // (1 << 16)) << 16
        p = np.ones(1, np.uint64)
        while len(p) < size:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])[:size]
        if size <= 1 << 21:
            _powers[base] = p
    return p[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of values[start:end] for each span of less than 1,024 values, themselves hashes; spans
    may overlap, and equal ones at any place hash alike."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(n + 1, _INVERSE)[starts])


def word_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each of some spans that don't overlap, in order; equal spans hash alike.

    Each value is mixed with its place in the span before the sum, so no pattern of values cancels out.
    """
    n = len(values)
    begin = np.zeros(n, np.int64)
    begin[starts] = starts
    place = (np.arange(n) - np.maximum.accumulate(begin)).view(np.uint64) if n else np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix((place << np.uint64(32) | values) * np.uint64(BASE) + np.uint64(_INVERSE)), out=total[1:])
    return mix(total[ends] - total[starts])


class Words:
    """Words of a batch whose texts each end in a byte outside the word class.

    starts, ends: byte spans; hash: of the lower-cased bytes; first: words before each text, and at
    the end the number of words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        self.low = LOWER[data]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = kind[data]
        step = np.diff(inside)
        self.starts = np.flatnonzero(step == 1)
        self.ends = np.flatnonzero(step == -1)
        self.hash = word_hash(self.low, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        """The text that each word stands in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def window_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` consecutive words, by the place of the first."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += hashes[k : k + n]
        out ^= out >> np.uint64(31)
    return mix(out)
