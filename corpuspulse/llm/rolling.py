"""Vectorised word splitting and polynomial (Rabin-Karp) hashes over Arrow text buffers.

All arithmetic is modulo 2**64 (numpy's unsigned wrap-around).  Bytes pass through a fixed random
table before the byte polynomial, and word hashes through a bit mixer before the window polynomial.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240501))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, so that polynomial structure does not reach the low bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def powers(base: U, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` for i < n (base is odd, so it has an inverse)."""
    have = _POW.get(int(base))
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        inv = U(pow(int(base), -1, 2**64))
        up, down = np.full(n, base, U), np.full(n, inv, U)
        up[0] = down[0] = 1
        have = _POW[int(base)] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def prefix(values: np.ndarray, base: U) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i`` with a leading zero."""
    up, _ = powers(base, len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:len(values)], out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: U) -> np.ndarray:
    """Polynomial hash of every ``values[start:end]`` from the prefix sums."""
    _, down = powers(base, len(pre))
    return (pre[end] - pre[start]) * down[start]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each white-space word of the texts ``data[offsets[i]:offsets[i+1]]`` and words per text."""
    solid = ~WHITE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = mix(spans(prefix(BYTE_CODE[data], BASE), s, e, BASE))
    counts = np.diff(np.searchsorted(s, offsets))
    return h, counts


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column (NULL counts as empty)."""
    import pyarrow as pa
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int):
    """Row ranges ``(a, b)`` of at most ``most`` bytes each (a longer text stands alone)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values (doubling steps, no loop over values)."""
    cur, size = x, 1
    while size * 2 <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    rest = w - size
    return np.minimum(cur[:len(cur) - rest], cur[rest:]) if rest else cur
