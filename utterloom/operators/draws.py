"""Bootstrap draws in numpy: the index of a draw is the first eight hex digits of an md5, so any engine can repeat it.

The md5s of one sample's positions are computed together; a message is one block of 64 bytes in which only the position's digits vary.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

#: Positions that are hashed at once, so that the buffers stay in cache.
CHUNK = 1 << 14

_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORD = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_A, _B, _C, _D = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476
_ALL = 0xFFFFFFFF


def first_digits(prefix: bytes, low: int, high: int) -> np.ndarray:
    """The first eight hex digits of md5(prefix + the decimal position), for positions from low up to high, all of as many digits."""
    size = len(str(low))
    n, total = high - low, len(prefix) + size
    if total > 55:
        return np.array([int(hashlib.md5(prefix + b"%d" % p).hexdigest()[:8], 16) for p in range(low, high)], np.uint32)
    block = bytearray(64)
    block[: len(prefix)], block[total], block[56:64] = prefix, 0x80, (8 * total).to_bytes(8, "little")
    fixed = [int.from_bytes(block[4 * k : 4 * k + 4], "little") for k in range(16)]
    varied: dict[int, np.ndarray] = {}
    rest = np.arange(low, high, dtype=np.uint32)
    for at in range(total - 1, len(prefix) - 1, -1):
        byte = (rest % np.uint32(10) + np.uint32(48)) << np.uint32(8 * (at % 4))
        rest //= np.uint32(10)
        varied[at // 4] = varied[at // 4] + byte if at // 4 in varied else byte
    a, b, c, d = (np.full(n, x, np.uint32) for x in (_A, _B, _C, _D))
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the word that counts is made in the last but three steps
        r = i // 16
        if r == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif r == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif r == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        k = _WORD[r](i)
        np.add(f, a, out=f)
        np.add(f, np.uint32((_K[i] + fixed[k]) & _ALL), out=f)
        if k in varied:
            np.add(f, varied[k], out=f)
        turn = _TURN[r][i % 4]
        np.left_shift(f, np.uint32(turn), out=t)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(t, f, out=t)
        np.add(t, b, out=t)
        a, b, c, d, t = d, t, b, c, a
    np.add(b, np.uint32(_A), out=b)
    return b.byteswap()


def positions(k: int) -> Iterator[tuple[int, int]]:
    """Ranges of positions below k that have as many digits, CHUNK at most."""
    low = 0
    while low < k:
        high = min(k, low + CHUNK, 10 ** len(str(low)))
        yield low, high
        low = high


def drawn_sums(seed: str, rep: int, columns: list[np.ndarray]) -> list[int]:
    """Sums of the columns over one sample: as many draws as they have values."""
    k = len(columns[0])
    prefix, sums = f"{seed}:{rep}:".encode(), [0] * len(columns)
    for low, high in positions(k):
        at = first_digits(prefix, low, high).astype(np.int64) % k
        for j, c in enumerate(columns):
            sums[j] += int(c[at].sum(dtype=np.int64))
    return sums
