"""Hashes of bootstrap draws, whole columns at a time.

``first_digits`` gives the first 32 bits of md5(head + id) as unsigned integers: the numbers that
``stability.uniform_hash`` takes from the hex digits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np

CHUNK = 8192  # messages of one pass: their words stay in a core's cache
_K = [int(abs(math.sin(i + 1)) * 2 ** 32) & 0xFFFFFFFF for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_STEP = [(1, 0), (5, 1), (3, 5), (7, 0)]
_A, _B, _C, _D = (np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))


def _first_word(words: list, n: int) -> np.ndarray:
    """Word A of the MD5 digests of ``n`` one-block messages; ``words`` are arrays, or ints where all messages agree."""
    a, b, c, d = (np.full(n, x) for x in (_A, _B, _C, _D))
    t = np.empty(n, dtype=np.uint32)
    for i in range(61):  # the last three steps do not touch word A
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        word = words[(_STEP[kind][0] * i + _STEP[kind][1]) % 16]
        if isinstance(word, int):
            t += np.uint32((_K[i] + word) & 0xFFFFFFFF)
        else:
            t += np.uint32(_K[i])
            t += word
        turn = _TURN[kind][i % 4]
        np.left_shift(t, np.uint32(turn), out=a)
        t >>= np.uint32(32 - turn)
        t |= a
        t += b
        a, b, c, d, t = d, t, b, c, a
    return b + _A


def _messages(head: int, tails: list[bytes]) -> np.ndarray:
    """Words (16 x messages) of tails of one length after ``head`` bytes that are left 0."""
    n, size = len(tails), len(tails[0])
    block = np.zeros((n, 64), dtype=np.uint8)
    block[:, head: head + size] = np.frombuffer(b"".join(tails), dtype=np.uint8).reshape(n, size)
    block[:, head + size] = 0x80
    block[:, 56:58] = np.frombuffer((8 * (head + size)).to_bytes(2, "little"), dtype=np.uint8)
    return np.ascontiguousarray(block.view("<u4").T)


def counts(heads: Sequence[bytes], tails: Sequence[bytes], thresholds: Sequence[float]) -> np.ndarray:
    """How many of ``thresholds`` lie at or below the uniform number of md5(head + tail): heads x tails."""
    return _hashed(heads, tails, np.uint8, lambda h: _above(h, thresholds))


def _above(h: np.ndarray, thresholds: Sequence[float]) -> np.ndarray:
    out = np.zeros(h.shape, dtype=np.uint8)
    for t in thresholds:
        least = math.ceil(t * 2 ** 32)  # h / 2^32 >= t, exactly: both sides are scaled by a power of two
        if least < 2 ** 32:
            out += h >= np.uint32(least)
    return out


def first_digits(heads: Sequence[bytes], tails: Sequence[bytes]) -> np.ndarray:
    """First 32 bits of md5(head + tail): heads x tails."""
    return _hashed(heads, tails, np.uint32, lambda h: h)


def _hashed(heads: Sequence[bytes], tails: Sequence[bytes], kind, use) -> np.ndarray:
    out = np.empty((len(heads), len(tails)), dtype=kind)
    sizes = np.array([len(x) for x in tails], dtype=np.int64)
    for size in np.unique(sizes):
        every = np.flatnonzero(sizes == size)
        size = int(size)
        for lo in range(0, len(every), CHUNK):
            at = every[lo: lo + CHUNK]
            texts = [tails[k] for k in at]
            packed: dict[int, np.ndarray] = {}
            for d, head in enumerate(heads):
                if len(head) + size > 55:  # more than one block
                    out[d, at] = use(np.array([int.from_bytes(hashlib.md5(head + x).digest()[:4], "big") for x in texts], dtype=np.uint32))
                    continue
                if len(head) not in packed:
                    packed[len(head)] = _messages(len(head), texts)
                base = packed[len(head)]
                start = np.frombuffer(head.ljust(64, b"\0"), dtype="<u4")
                last = (len(head) + size) // 4  # words after it are empty, but for the length
                first = -(-len(head) // 4)
                words = [base[w] | start[w] if w < first else base[w] if w <= last else 8 * (len(head) + size) if w == 14 else 0 for w in range(16)]
                out[d, at] = use(_first_word(words, len(at)).byteswap())
    return out
