"""Vectorised tokens of whole texts: byte classes, word hashes and shingles of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
MASK48 = U((1 << 48) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift and multiply rounds)."""
    x = x ^ (x >> U(31))
    x = x * U(0x9E3779B97F4A7C15)
    x = x ^ (x >> U(29))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


mix = _mix

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words are runs of anything but the six ASCII blanks
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: words are runs of ASCII letters, digits and all bytes of other characters
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = True
ALNUM[0x80:] = True

_BYTE = _mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))
_BASE, _INV = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_pow: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for i, b in enumerate((_BASE, _INV)):
            a = np.full(max(n, SLICE_BYTES + 1), U(b))
            a[0] = 1
            _pow[i] = np.multiply.accumulate(a)
    return _pow[0], _pow[1]


def slices(arr: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last, bytes, row offsets) of runs of rows of at most max_bytes, or one row; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()) if not pa.types.is_large_string(arr.type) else arr
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if not n:
        return
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + max_bytes, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row where its words begin (one entry more than rows)."""
    n = len(data)
    w = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = w[:-1]
    before &= ~edge[:-1]
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = w[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
    p, inv = _powers(len(data) + 1)
    c = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * p[: len(data)], out=c[1:])
    return _mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(U) * U(0xC2B2AE3D27D4EB4F))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive entries, from each position (the last k - 1 have none)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n] * U(0x8CB92BA72F3D8DD7)
    for i in range(1, k):
        out = (out ^ (out >> U(27))) * U(0x9FB21C651E98DF25) + h[i : i + n] * U(0x8CB92BA72F3D8DD7)
    return _mix(out + U(k))


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each row its sorted distinct 48-bit shingle hashes (k words; fewer words: the whole sequence; none: empty)."""
    low = LOWER[data]
    starts, ends, first = words(low, offs, NOT_BLANK)
    h = word_hashes(low, starts, ends)
    r = runs(h, k) & MASK48
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(r[a : b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            yield runs(h[a:b], b - a) & MASK48 if b > a else np.zeros(0, U)


def set_id(s: np.ndarray) -> int:
    """A 64-bit id of a set, whatever the order; 0 is kept for the empty set."""
    if not len(s):
        return 0
    x = (int(_mix(s).sum(dtype=U)) + len(s) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return int(_mix(np.array([x], U)).view(np.int64)[0]) or 1
