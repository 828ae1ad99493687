"""Words of Arrow text columns as numpy arrays of hashes, a few megabytes of whole texts at a time.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  Its hash is a polynomial over random
values of its bytes, modulo 2^64, mixed with its length; words are told apart by these 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE_LOWER = _BYTE[_LOWER]
_P = int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _table(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 21), base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name]


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, in the order of the texts
    bounds: np.ndarray  # int64, the words of text i are hashes[bounds[i]:bounds[i + 1]]


def pieces(column: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets of the texts)`` of runs of whole texts of about ``size``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        own = offsets[start : end + 1]
        yield start, end, data[own[0] : own[-1]], own - own[0]
        start = end


def word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words, and the bytes behind their last."""
    n = len(data)
    word = ~_SPACE[data]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]  # texts do not run into each other
    starts[edges] = word[edges]
    ends[edges - 1] = word[edges - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """Hash of the bytes ``data[start:end]`` of each span."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[data] * _table("up", _P, n)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _table("down", _P_INVERSE, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends = word_edges(data, offsets)
    return Words(span_hashes(data, starts, ends, _BYTE_LOWER), np.searchsorted(starts, offsets, "left"))


def combined(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words; runs over the ends of texts included."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, n, dtype=np.uint64)
    for i in range(n):
        out = mix(out + hashes[i : i + count])
    return out


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Like ``combined``, from running sums: the cost does not depend on ``n``."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * _table("up", _P, len(hashes))[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * _table("down", _P_INVERSE, len(hashes))[:count])
