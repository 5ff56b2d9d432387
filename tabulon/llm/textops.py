"""Vectorised text primitives over Arrow string columns.

Texts are handled as UTF-8 bytes: words are runs of bytes outside 0x20 and 0x09-0x0D, which
no byte of a multi-byte character is. Work goes in chunks of bounded size, at least a whole
text each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_TAB = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WS = np.zeros(256, dtype=bool)
IS_WS[[0x20, *range(0x09, 0x0E)]] = True

_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)


def _powers(n: int):
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK + 4096)
        with np.errstate(over="ignore"):
            _pow = np.cumprod(np.r_[U64(1), np.full(size - 1, _BASE, dtype=U64)], dtype=U64)
            _inv = np.cumprod(np.r_[U64(1), np.full(size - 1, _BASE_INV, dtype=U64)], dtype=U64)
    return _pow[:n], _inv[: n + 1] if len(_inv) > n else np.r_[_inv, _inv[-1:] * U64(_BASE_INV)]


def fmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of an Arrow string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Row ranges whose texts have about ``size`` bytes, a single longer text being one range."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def spans(buf: np.ndarray, offsets: np.ndarray, is_break: np.ndarray):
    """Starts and ends of the maximal runs of bytes outside ``is_break``; none crosses a text.
    Also how many runs stand before each of the n + 1 offsets."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~is_break[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of byte spans, the same wherever a span stands."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    pw, inv = _powers(len(buf))
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, U64)
        np.cumsum(_TAB[LOWER[buf] if lower else buf] * pw, out=total[1:])
        return fmix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """Hashes of all words and how many words stand before each offset."""
    starts, ends, before = spans(buf, offsets, IS_WS)
    return span_hashes(buf, starts, ends, lower), before


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its shingles of ``width`` words; a text with
    fewer words has its whole word sequence as one, and one without words has none."""
    h, before = word_hashes(buf, offsets)
    out = []
    with np.errstate(over="ignore"):
        g = h.copy()
        for k in range(1, width):
            if len(h) > k:
                g[: len(h) - k] = g[: len(h) - k] * U64(0x9DDFEA08EB382D69) + h[k:]
        g = fmix(g)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(g[a : b - width + 1]))
            elif b > a:
                x = h[a : a + 1].copy()
                for k in range(a + 1, b):
                    x = x * U64(0x9DDFEA08EB382D69) + h[k]
                out.append(fmix(x ^ U64(b - a)))
            else:
                out.append(np.zeros(0, U64))
    return out
