"""Vectorised scans over the UTF-8 bytes of Arrow text columns.

All functions work on a *pack*: the bytes of a slice of documents laid end to end, each
followed by ``gap`` filler bytes, so that nothing found in it spans two documents. Slices are
cut by bytes, so memory stays bounded by ``SLICE_BYTES`` or the one longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 300_000

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[str, np.ndarray] = {}


def powers(name: str, n: int) -> np.ndarray:
    """The first n powers of the hash base (``up``) or of its inverse (``down``), mod 2^64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 1))
        base = np.full(size, _P if name == "up" else _P_INV, np.uint64)
        base[0] = 1
        _powers[name] = have = np.multiply.accumulate(base)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Pack:
    """Bytes of ``n`` documents with filler between them; ``first``/``last`` bound each one."""

    buf: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @property
    def n(self) -> int:
        return len(self.first)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, side="right") - 1


def _text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, raw


def slices(column: pa.Array, gap: int = 1, filler: int = 0x0A, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Pack]]:
    """(begin, end, pack) of consecutive row ranges; a null text is an empty document."""
    n = len(column)
    if n == 0:
        return
    offsets, raw = _text_buffers(column)
    lengths = np.diff(offsets)
    begin = 0
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1
        end = min(max(end, begin + 1), n)
        lens = lengths[begin:end]
        total = int(offsets[end] - offsets[begin])
        m = end - begin
        buf = np.full(total + gap * (m + 1), filler, np.uint8)
        first = np.concatenate(([0], np.cumsum(lens[:-1] + gap))) + gap
        if total:
            shift = np.repeat(first - (offsets[begin:end] - offsets[begin]), lens)
            buf[np.arange(total) + shift] = raw[offsets[begin] : offsets[end]]
        yield begin, end, Pack(buf, first.astype(np.int64), (first + lens).astype(np.int64))
        begin = end


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of the runs of True."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(mask)]))
    return edge[::2], edge[1::2]


def span_hashes(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: equal bytes, equal hash, wherever they stand."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers("up", len(buf)), out=total[1:])
    h = (total[ends] - total[begins]) * powers("down", len(buf))[begins]
    return mix(h ^ ((ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def window_hashes(words: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words inside one document, and their first word's index."""
    m = len(words) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(docs[:m] == docs[width - 1 :])
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[at + k] + np.uint64(k))
    return h, at


def per_doc(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Sums by document, exact for integers below 2^53."""
    return np.bincount(docs, weights=values, minlength=n)
