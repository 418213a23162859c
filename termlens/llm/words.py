"""Vectorised word splitting and 64-bit hashing over the UTF-8 buffers of Arrow string columns.

A word hash runs over the word's eight-byte lanes with a non-linear mix after each, for all words of a slice at once
(words above `LONG_WORD` bytes by XXH3, one by one); a second seed gives an independent second hash. The hash of an
n-word window is a polynomial over the word hashes, for all windows from one prefix sum (odd multipliers have inverses,
so a prefix-sum difference can be shifted back to position 0). Memory is bounded by `SLICE_BYTES` per slice (or the
longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 19
LONG_WORD = 256              # bytes
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xC2B2AE3D27D4EB4F | 1
_R = 0xD6E8FEB86659FD93 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, grown on demand and kept for the worker's life."""
    have = _cache.get(base)
    if have is None or len(have) < n:
        have = _powers(base, max(n, SLICE_BYTES + (SLICE_BYTES >> 1)))
        if n <= 8 * SLICE_BYTES:
            _cache[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: keeps the first 0 .. 8 bytes of a little-endian lane
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

#: bytes 0x20, 0x09..0x0D separate words
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, 9, 10, 11, 12, 13]] = False
#: words are runs of 0-9, a-z (after lower-casing) and non-ASCII bytes
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = True
ALNUM_WORDS[0x61:0x7B] = True
ALNUM_WORDS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(col: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about `size` bytes; a null text counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if n == 0:
        return
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + n + 1]
    data = col.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j, whole[offs[i]:offs[j]], (offs[i:j + 1] - offs[i])
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word index of every row (rows + 1 entries)."""
    n = len(buf)
    m = is_word[buf]
    before = np.zeros(n, dtype=bool)
    before[1:] = m[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = m[1:]
    first = offs[:-1]
    before[first[first < n]] = False
    last = offs[1:]
    after[last[last > 0] - 1] = False
    s = np.flatnonzero(m & ~before)
    e = np.flatnonzero(m & ~after) + 1
    return s, e, np.searchsorted(s, offs)


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every word (equal bytes, equal hash, wherever the word stands)."""
    n = e - s
    h = mix(n.astype(np.uint64) * np.uint64(_P) + np.uint64(seed * _R & _MASK))
    if not len(s):
        return h
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[:len(buf)] = buf
    lanes = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))      # the eight bytes from every position
    live, at = np.flatnonzero((n > 0) & (n <= LONG_WORD)), 0
    while len(live):
        x = lanes[s[live] + at] & _KEEP[np.minimum(n[live] - at, 8)]
        h[live] = mix((h[live] ^ x) * np.uint64(_Q))
        at += 8
        live = live[n[live] > at]
    for k in np.flatnonzero(n > LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(buf[s[k]:e[k]].tobytes(), seed)
    return h


def window_hashes(wh: np.ndarray, width: int, base: int = _Q) -> np.ndarray:
    """Hash of every run of `width` word hashes (length n - width + 1, or 0)."""
    n = len(wh)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    pre = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(wh * powers(base, n), out=pre[1:])
    return mix((pre[width:] - pre[:-width]) * powers(inverse(base), n)[:n - width + 1])


def second_window_hashes(wh2: np.ndarray, width: int) -> np.ndarray:
    """Hash of the same windows from word hashes of another seed and another base; with the first a 128-bit key."""
    return window_hashes(wh2, width, _R)


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes kept."""
    return LOWER[buf]
