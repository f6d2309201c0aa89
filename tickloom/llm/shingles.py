"""Word shingles of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20_240_601)
BYTE = _rng.integers(0, 2 ** 64, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2 ** 64))
ORDER = _rng.integers(0, 2 ** 64, 64, np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's begin (one more bound than texts).

    A-Z is lowered; words are what lies between ASCII white space. A text with fewer than ``width`` words has
    its whole sequence as one shingle, one without words has none.
    """
    raw = [t.encode().lower() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    lengths = np.array([len(r) for r in raw], np.int64)
    text_end = np.cumsum(lengths + 1)  # position of the space after each text
    gap = SPACE[data]
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(BASE, len(data)), dtype=np.uint64)])
    word = (total[end] - total[start]) * powers(INVERSE, len(data))[start]
    word = mixed(word + (end - start).astype(np.uint64) * ORDER[0])
    first = np.searchsorted(start, np.concatenate([[0], text_end]))  # words before each text
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), counts)
    n = len(word)
    h = np.zeros(n, np.uint64)
    left = np.repeat(first[1:], counts) - np.arange(n)  # words from here to the end of the text
    for k in range(width):
        h[:n - k] += np.where(left[:n - k] > k, word[k:] * ORDER[k + 1], np.uint64(0)) if n > k else 0
    short = np.repeat(counts < width, counts)
    at_start = np.zeros(n, bool)
    at_start[first[:-1][counts > 0]] = True
    keep = (left >= width) | (short & at_start)
    size = np.minimum(np.repeat(counts, counts), width).astype(np.uint64)
    h, owner = mixed(h + size * ORDER[width + 1])[keep], owner[keep]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[fresh], owner[fresh]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays without repeats have in common."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
