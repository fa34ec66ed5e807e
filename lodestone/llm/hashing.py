"""Vectorised word hashing over UTF-8 buffers, and Golomb-Rice coding of sorted fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SEGMENT = 1 << 18


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, 256, dtype=U) | U(1), rng.integers(1, 1 << 63, 65536, dtype=U) | U(1)


_TABLES = {seed: _tables(seed) for seed in (11, 12)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values, by a sort (np.unique hashes, which is slower on wide integers)."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the maximal runs of bytes outside `sep` in each text."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~sep[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 11) -> np.ndarray:
    """64-bit hash of each word's bytes, in bounded slices of the buffer."""
    table, power = _TABLES[seed]
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _SEGMENT)))
        a, b = int(starts[i]), int(ends[j - 1])
        s = starts[i:j] - a
        size = ends[i:j] - starts[i:j]
        at = np.arange(b - a, dtype=np.int64)
        at -= np.repeat(s, np.diff(np.append(s, b - a)))
        value = table[buf[a:b]] * power[at & 65535]
        if size.max() > 65536:
            value *= (U(2) * (at >> 16).astype(U)) + U(1)
        value[at >= np.repeat(size, np.diff(np.append(s, b - a)))] = 0
        out[i:j] = mix(np.add.reduceat(value, s) + size.astype(U) * U(0x9E3779B97F4A7C15))
        i = j
    return out


def double(h: np.ndarray, length: int, to: int) -> np.ndarray:
    """Hashes of windows of `to` words (length < to <= 2 * length) from those of `length` words:
    the window's head and tail combined. Entry p stands for the window that starts at word p."""
    step = to - length
    if len(h) <= step:
        return np.zeros(0, U)
    return mix(h[:-step] * U(0xD6E8FEB86659FD93) + mix(h[step:] + U(to)))


def rice_encode(sorted_values: np.ndarray, bits: int) -> bytes:
    """Golomb-Rice code of ascending unsigned values below 2**bits. The first byte is the Rice
    parameter; then the unary quotients and the fixed-width remainders, both packed."""
    n = len(sorted_values)
    if n == 0:
        return b""
    gaps = np.diff(sorted_values, prepend=U(0))
    k = max(0, min(56, bits - max(0, n.bit_length() - 1)))
    span = float(sorted_values[-1]) / n
    while k > 0 and (1 << k) > max(1.0, span):
        k -= 1
    quotient = (gaps >> U(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    parts = [bytes([k]), len(unary).to_bytes(8, "little"), np.packbits(unary).tobytes()]
    if k:
        for i in range(0, n, 1 << 17):
            low = (gaps[i : i + (1 << 17)] & U((1 << k) - 1)).astype(">u8").view(np.uint8).reshape(-1, 8)
            parts.append(np.packbits(np.unpackbits(low, axis=1)[:, 64 - k :]).tobytes())
    return b"".join(parts)


def rice_decode(blob: bytes, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, U)
    k, size = blob[0], int.from_bytes(blob[1:9], "little")
    at = 9 + (size + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, at - 9, 9))[:size]
    gaps = (np.diff(np.flatnonzero(unary), prepend=-1) - 1).astype(U) << U(k)
    if k:
        for i in range(0, n, 1 << 17):
            m = min(1 << 17, n - i)
            size = (m * k + 7) // 8
            low = np.unpackbits(np.frombuffer(blob, np.uint8, size, at))[: m * k].reshape(m, k)
            wide = np.zeros((m, 64), np.uint8)
            wide[:, 64 - k :] = low
            gaps[i : i + m] += np.packbits(wide, axis=1).view(">u8").reshape(-1).astype(U)
            at += size
    return np.cumsum(gaps, dtype=U)
