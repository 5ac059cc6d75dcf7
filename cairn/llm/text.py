"""Vectorised text kernels over Arrow string columns.

All functions work on the UTF-8 bytes of a batch of texts at once.  Splitting
and lower-casing are defined on ASCII characters only, so they can be done on
bytes: every byte of a multi-byte character is 0x80 or more.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; bounds the memory of the 64-bit intermediates.
BLOCK = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of anything but the space and the controls 09 to 0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Words are runs of digits, lower-case letters and non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS:
        up = np.full(BLOCK, _BASE, dtype=np.uint64)
        up[0] = 1
        down = np.full(BLOCK, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each text starts (one more at the end). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK * 4) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``size`` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = raw(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        release()


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task, and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def spans(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes inside each text: starts, ends, and the number of the first run of each text (one more at the end)."""
    inside = member[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = off[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: a polynomial modulo 2**64, finalised with the length."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers()
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        if hi - lo <= BLOCK:
            part = np.empty(hi - lo + 1, np.uint64)
            part[0] = 0
            np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=part[1:])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = (part[e] - part[s]) * down[np.minimum(s, BLOCK - 1)]
        else:  # one span longer than a block
            total, scale = 0, 1
            for b in range(lo, hi, BLOCK):
                piece = data[b : min(b + BLOCK, hi)].astype(np.uint64) + np.uint64(1)
                total = (total + scale * int((piece * up[: len(piece)]).sum(dtype=np.uint64))) % (1 << 64)
                scale = scale * pow(_BASE, len(piece), 1 << 64) % (1 << 64)
            out[at] = total
        at = to
    return mix(out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def words(column: pa.Array, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the lower-cased texts, and the number of the first word of each text (one more at the end)."""
    data, off = raw(column)
    data = LOWER[data]
    starts, ends, first = spans(data, off, member)
    return hashes(data, starts, ends), first


def windows(word: np.ndarray, first: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words within a text, and the number of the first run of each text.

    With ``short``, a text of fewer words, but not none, has one run: the whole.
    """
    count = np.diff(first)
    made = np.maximum(count - width + 1, (count > 0).astype(count.dtype) if short else 0)
    start = np.concatenate([[0], np.cumsum(made)])
    at = np.repeat(first[:-1] - start[:-1], made) + np.arange(start[-1])
    stop = np.repeat(first[1:], made)
    out = np.full(len(at), 0x2545F4914F6CDD1D, np.uint64)
    for k in range(width):
        there = at + k < stop
        w = word[np.minimum(at + k, max(len(word) - 1, 0))] if len(word) else np.zeros(0, np.uint64)
        out = np.where(there, mix(out * np.uint64(0x9FB21C651E98DF25) + w), out)
    return out, start


def distinct(values: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each group's distinct values in ascending order, and where each group starts."""
    group = np.repeat(np.arange(len(start) - 1), np.diff(start))
    order = np.lexsort((values, group))
    values, group = values[order], group[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
    values, group = values[keep], group[keep]
    return values, np.searchsorted(group, np.arange(len(start)))
