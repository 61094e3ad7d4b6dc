"""Tokens of whole texts as numbers, in bulk: what ranking in a scan needs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes and texts of a chunk at most; a longer text is a chunk of its own.
CHUNK, ROWS = 1 << 20, 2048
#: Bytes of a piece at most, unless a word is longer: what is held for every byte has this bound, not a text's length.
PIECE = 1 << 17

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = 0x9E3779B97F4A7C15
_powers = {1: np.ones(1, U), -1: np.ones(1, U)}


def _power(sign: int, n: int) -> np.ndarray:
    if len(_powers[sign]) < n:
        x = np.full(max(n, PIECE + 1), _STEP if sign > 0 else pow(_STEP, -1, 1 << 64), U)
        x[0] = 1
        _powers[sign] = np.multiply.accumulate(x)
    return _powers[sign][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_CODES = _mix(np.arange(1, 257, dtype=U))


def _pieces(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of pieces of buf that cut no word."""
    lo = 0
    while lo < len(buf):
        hi = min(lo + PIECE, len(buf))
        if hi < len(buf) and _WORD[buf[hi - 1]] and _WORD[buf[hi]]:
            gap = np.flatnonzero(~_WORD[buf[lo:hi]])
            if len(gap):
                hi = lo + int(gap[-1]) + 1
            else:
                while hi < len(buf) and not len(gap := np.flatnonzero(~_WORD[buf[hi : hi + PIECE]])):
                    hi += PIECE
                hi = hi + int(gap[0]) if hi < len(buf) else len(buf)
        yield lo, hi
        lo = hi


def _hashes(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a piece's tokens and where each starts; bounds: where texts start in it, which end a token too."""
    inside = np.concatenate(([False], _WORD[buf], [False]))
    cut = np.zeros(len(buf) + 1, bool)
    cut[bounds] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    total = np.zeros(len(buf) + 1, U)
    np.cumsum(_CODES[_LOWER[buf]] * _power(1, len(buf)), out=total[1:])
    return _mix((total[end] - total[start]) * _power(-1, len(buf) + 1)[start] + (end - start).astype(U)), start


def tokens(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, text numbers): every lower-cased run of ASCII letters, digits and underscores.

    Tokens are those of functions.text.tokens, told apart by 64-bit hashes; null texts have none.
    """
    for first in range(0, len(col), ROWS):
        part = col.slice(first, ROWS).cast(pa.large_binary()).fill_null(b"")
        n = len(part)
        offs = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + n + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = min(max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK, "right")) - 1), n)
            buf, at = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            h, doc = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for a, z in _pieces(buf):
                got, start = _hashes(buf[a:z], at[np.searchsorted(at, a) : np.searchsorted(at, z, "right")] - a)
                h.append(got)
                doc.append(np.searchsorted(at, start + a, "right") - 1)
            h, doc = np.concatenate(h), np.concatenate(doc)
            yield first + lo, first + hi, h, doc
            lo = hi
