"""Vectorised work on the bytes of whole texts, in chunks of bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A text longer than this is a chunk of its own; a chunk has at most this many texts.
CHUNK, ROWS = 1 << 20, 2048

_R = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}
_tables: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = _R if kind == "up" else pow(_R, -1, 1 << 64)
        have = np.full(max(n, CHUNK + 1), base, U)
        have[0] = 1
        have = _powers[kind] = np.multiply.accumulate(have)
    return have[:n]


def _table(seed: int) -> np.ndarray:
    if seed not in _tables:
        _tables[seed] = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95) + U(seed))
    return _tables[seed]


def prefix(buf: np.ndarray, seed: int = 1) -> np.ndarray:
    """Prefix sums from which the hash of any substring follows in constant time."""
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(_table(seed)[buf] * _power("up", len(buf)), out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], equal for equal bytes at any place."""
    return mix((pre[end] - pre[start]) * _power("down", len(pre))[start] + (end - start).astype(U))


def texts(col: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + ROWS)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run without white space."""
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = ~SPACE[buf]
    begins = inside[:-1].copy()
    begins[1:] &= SPACE[buf[:-1]] if len(buf) else True
    first = offs[:-1][offs[:-1] < len(buf)]
    begins[first] = inside[:-1][first]
    ends = inside[:-1] & ~inside[1:]
    last = offs[1:][offs[1:] > 0] - 1
    ends[last] = inside[:-1][last]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offs, start, "right") - 1


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool = True, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word in order."""
    start, end, doc = words(buf, offs)
    pre = prefix(LOWER[buf] if lower else buf, seed)
    return spans(pre, start, end), doc


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of the word k-shingles, distinct within a text and ascending, with their text numbers.

    A text of fewer than k words gives its whole sequence as one shingle, a text without words none.
    """
    h, doc = word_hashes(buf, offs)
    n = len(offs) - 1
    count = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    total = np.zeros(max(0, len(h) - k + 1), U)
    q = 1
    for i in range(k):
        total += h[i : i + len(total)] * U(q)
        q = q * 0xC2B2AE3D27D4EB4F & (2**64 - 1)
    inside = doc[: len(total)] == doc[k - 1 :] if len(total) else np.zeros(0, bool)
    key, at = mix(total[inside]), doc[: len(total)][inside]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.zeros(len(short), U)
        for j, d in enumerate(short):
            q = int(count[d])
            for x in h[first[d] : first[d + 1]].tolist():
                q = (q * 0x9E3779B185EBCA87 + x) & (2**64 - 1)
            whole[j] = q
        key, at = np.concatenate((key, mix(whole ^ U(0x5851F42D4C957F2D)))), np.concatenate((at, short))
    key = key >> U(1)
    order = np.lexsort((key, at))
    key, at = key[order], at[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
    return key[new], at[new]
