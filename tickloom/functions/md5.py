"""MD5 of many short texts side by side."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np

ROWS = 16_384
TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16, 32)], *[(3 * i + 5) % 16 for i in range(32, 48)],
        *[7 * i % 16 for i in range(48, 64)]]


def first_words(words: dict[int, np.ndarray], fixed: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digest of n texts of one block. ``fixed`` has the block's 16 words, to which ``words``
    adds what differs from text to text."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in BEGIN)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += np.uint32((SINES[i] + fixed[WORD[i]]) & 0xFFFFFFFF)
        if WORD[i] in words:
            f += words[WORD[i]]
        np.left_shift(f, np.uint32(TURNS[i]), out=t)
        f >>= np.uint32(32 - TURNS[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return a + np.uint32(BEGIN[0]), b + np.uint32(BEGIN[1])


def heads(n: int, seconds: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``seconds`` the first 15 hex digits, as numbers, of the MD5 of "0-second" to "(n - 1)-second"."""
    parts = []
    for digits in range(1, len(str(max(n - 1, 0))) + 1):
        for first in range(10 ** (digits - 1) if digits > 1 else 0, min(n, 10 ** digits), ROWS):
            number = np.arange(first, min(first + ROWS, n, 10 ** digits))
            words: dict[int, np.ndarray] = {}
            for k in range(digits):
                sign = (number // 10 ** (digits - 1 - k) % 10 + 48).astype(np.uint32) << np.uint32(8 * (k % 4))
                words[k // 4] = words[k // 4] | sign if k // 4 in words else sign
            parts.append((digits, first, words, len(number)))
    for second in seconds:
        out = np.empty(n, np.uint64)
        for digits, first, words, rows in parts:
            text = bytes(digits) + f"-{second}".encode()
            block = (text + b"\x80").ljust(56, b"\0") + (8 * len(text)).to_bytes(8, "little")
            fixed = np.frombuffer(block, "<u4").tolist()
            a, b = first_words(words, fixed, rows)
            out[first:first + rows] = (a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()) >> np.uint64(4)
        yield second, out
