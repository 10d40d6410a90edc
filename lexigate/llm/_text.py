"""Vectorised text helpers shared by the operators of this subpackage.

Every helper works on a *block*: the UTF-8 bytes of some consecutive rows and their
offsets. Blocks hold about ``BLOCK`` bytes (one longer text makes its own block), so
a task's memory follows the block and the longest text, never its partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
#: Bytes that are hashed together.
SOME = 1 << 14

#: Byte classes: True where the byte belongs to a word.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x41:0x5B] = True
ALNUM_WORDS[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, up to exponent n - 1."""
    if len(_powers["p"]) < n:
        size = 1 << (n - 1).bit_length()
        p = np.full(size, _BASE, np.uint64)
        q = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        _powers["p"], _powers["q"] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over uint64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column as strings; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col if pa.types.is_large_string(col.type) else col.cast(pa.large_string()), "")


def blocks(batch: pa.RecordBatch, name: str = "text", size: int = BLOCK):
    """Cut a batch into blocks: (first row, end row, bytes, offsets from 0)."""
    col = texts(batch, name)
    if not len(col):
        return
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """The words of a block: start and end byte, row, and the index of each row's first word."""

    __slots__ = ("end", "first", "row", "start")

    def __init__(self, start: np.ndarray, end: np.ndarray, offsets: np.ndarray):
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offsets)  # rows' first words; one more entry at the end
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of ``inside`` bytes; no run crosses from one row into the next."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, offsets)
    m = np.frombuffer(data.tobytes().translate(inside.tobytes()), bool)
    begin, stop = m.copy(), m.copy()
    begin[1:] &= ~m[:-1]
    stop[:-1] &= ~m[1:]
    full = offsets[:-1] < offsets[1:]
    at = offsets[:-1][full]
    begin[at] = m[at]
    at = offsets[1:][full] - 1
    stop[at] = m[at]
    return Words(np.flatnonzero(begin), np.flatnonzero(stop) + 1, offsets)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes at any position."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(data)
    p, q = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    factors = _BYTE2 if second else _BYTE
    for a in range(0, n, SOME):  # so many that they stay in a core's cache
        some = factors[data[a : a + SOME]]
        some *= p[a : a + len(some)]
        some[:1] += total[a : a + 1]
        np.cumsum(some, out=total[a + 1 : a + 1 + len(some)])
    return mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64) * np.uint64(_STEP))


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (for every start that has k of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(_BASE)
        out += h[i : i + n]
    return mix(out)


def fold_hash(h: np.ndarray) -> int:
    """Hash of a whole word sequence."""
    out = 0x243F6A8885A308D3
    for x in h.tolist():
        out = ((out ^ x) * _BASE) & 0xFFFFFFFFFFFFFFFF
        out ^= out >> 29
    return out


def id16(a: np.ndarray, b: np.ndarray) -> pa.Array:
    """Two uint64 columns as one 16-byte binary column."""
    raw = np.empty((len(a), 2), ">u8")
    raw[:, 0], raw[:, 1] = a, b
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def int_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A list<int64> column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64()))
