"""Vectorised text work on Arrow buffers: no Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased. Words are known by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_ROW = 4096


def power_table(n: int, base: int = _BASE) -> np.ndarray:
    """base**k modulo 2**64 for k < n, at least."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out


_POWERS = power_table(_ROW)


def _powers(k: np.ndarray, most: int) -> np.ndarray:
    """_BASE**k modulo 2**64 for k < most: by a table of rows, so that a word of any length needs little memory."""
    if most <= _ROW:
        return _POWERS[k]
    return _POWERS[k % _ROW] * power_table(most // _ROW + 1, pow(_BASE, _ROW, 1 << 64))[k // _ROW]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a text column; a null is an empty text."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pc.fill_null(a.cast(pa.large_string()), "")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    if not len(off):
        off = np.zeros(1, np.int64)
    return data[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes; a longer document is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Letters, digits and every byte of a longer UTF-8 character; anything else parts words where punctuation must not count.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word, and where each document's words begin (one entry more than documents)."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(off), np.int64)
    full = ~space[data]
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = full[edge]
    last[edge - 1] = full[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lut: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of each span's bytes (spans ascending, disjoint, not empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    within = np.arange(int(lens.sum())) - np.repeat(at, lens)
    b = lut[data[np.repeat(starts, lens) + within]].astype(np.uint64)
    b += np.uint64(1)
    b *= _powers(within, int(lens.max()))
    return mix(np.add.reduceat(b, at) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and where each document's words begin."""
    starts, ends, woff = spans(data, off, space)
    return hash_spans(data, starts, ends), woff


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words (n - 1 fewer than words; document borders are not looked at)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h *= np.uint64(0xD1342543DE82EF95)
        h += words[k : k + m]
    return mix(h)


def shingle_sets(words: np.ndarray, woff: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Each document's sorted distinct n-word shingles; with fewer words the whole sequence is one; none without words."""
    grams, out = ngram_hashes(words, n), []
    for a, b in zip(woff[:-1].tolist(), woff[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mix(ngram_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
