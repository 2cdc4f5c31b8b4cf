"""Vectorised access to Arrow text columns, shared by the operators that run on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; bounds the memory of the numpy work areas (some 50 times as much) whatever a batch holds.
CHUNK_BYTES = 1 << 20

#: The white space that separates words: space and \t \n \v \f \r; a table by byte value.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: An odd multiplier for rolling hashes modulo 2**64, and its inverse there.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def give_back() -> None:
    """Return freed memory to the system, at the end of a task that held much: idle workers stay, beside those at work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def frugal(run):
    """A function over Arrow batches that gives its memory back at the end of each task."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    """A text column with nulls as empty texts."""
    array = batch.column(name)
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    return pc.fill_null(array, "")


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a large_string array, and n+1 offsets into them."""
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(array: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` text bytes each, but one row at least."""
    _, offsets = raw(array)
    start, n = 0, len(array)
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words; words of row i are first[i]:first[i+1]."""
    inside = ~IS_SPACE[data]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False  # a text's first byte starts a word
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[-1] = False
        after[:-1] = inside[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, np.uint64(base & (2**64 - 1))
    while done < n:  # doubling
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
        step = step * step
    return out[:n]


_POWERS: dict[int, np.ndarray] = {}


def _cached_powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _POWERS[base] = powers(base, max(n, CHUNK_BYTES + 1))
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 1) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans, equal hashes."""
    with np.errstate(over="ignore"):
        table = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64((0xD6E8FEB86659FD93 * (2 * salt + 1)) & (2**64 - 1)))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * _cached_powers(BASE, len(data)), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _cached_powers(BASE_INVERSE, len(data) + 1)[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive values of h (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out = out * np.uint64(BASE) + h[k : k + m]
        return mix(out)
