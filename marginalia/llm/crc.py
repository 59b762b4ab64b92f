"""CRC-32 of many byte spans at once, and of spans put together, with numpy."""

from __future__ import annotations

import zlib

import numpy as np

POLYNOMIAL = np.uint32(0xEDB88320)
#: Longer spans go to zlib one by one.
SHORT = 48
_FULL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ POLYNOMIAL, c >> 1)
    return c


TABLE = _byte_table()


def crc32_of_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of buf[start:end] for each span (uint32)."""
    length = end - start
    out = np.zeros(len(start), dtype=np.uint32)
    data = memoryview(np.ascontiguousarray(buf))
    for i in np.flatnonzero(length > SHORT).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]])
    short = np.flatnonzero(length <= SHORT)
    order = short[np.argsort(-length[short], kind="stable")]  # at each step the spans that go on are the first ones
    goes_on = np.bincount(length[order], minlength=SHORT + 1)[::-1].cumsum()[::-1]
    at, c = start[order], np.full(len(order), _FULL, dtype=np.uint32)
    for j in range(SHORT):
        n = int(goes_on[j + 1])
        if not n:
            break
        c[:n] = TABLE[(c[:n] ^ buf[at[:n] + j]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out[order] = c ^ _FULL
    return out


_SHIFTS = [np.stack([TABLE[v & 255] ^ (v >> np.uint32(8)) for v in (np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4))])]


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & np.uint32(255)] ^ tables[1][c >> np.uint32(8) & np.uint32(255)] ^ tables[2][c >> np.uint32(16) & np.uint32(255)] ^ tables[3][c >> np.uint32(24)]


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the CRC of a span counts for once n more bytes stand behind it: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    out = crc.copy()
    for k in range(int(n.max(initial=0)).bit_length()):
        if k == len(_SHIFTS):
            _SHIFTS.append(_apply(_SHIFTS[-1], _SHIFTS[-1]))
        here = np.flatnonzero(n >> k & 1)
        out[here] = _apply(_SHIFTS[k], out[here])
    return out
