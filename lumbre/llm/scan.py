"""Texts of an Arrow batch as numpy arrays: words, word hashes and hashes of word runs.

All functions work on UTF-8 bytes of many documents at once, so a task spends its time in numpy and
holds at most ``CHUNK_BYTES`` of text (or one longer document) in this form.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_P, _Q = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}

#: words are runs of bytes other than space and the control characters tab to carriage return
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: words are runs of ASCII letters and digits and of every character beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0], k = 1, 1
        while k < size:
            have[k:2 * k] = have[:k] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n + 1]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each pair; it depends on the values alone, not on where they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_P, len(values))[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_Q, len(values))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words, and which of them lie in one document."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(n)
    return run_hashes(hashes, at, at + k), doc[:n] == doc[k - 1:]


def text_column(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


@dataclass
class Words:
    """Words of the rows ``first`` to ``last``: byte positions in ``data``, row of each (from 0 at ``first``) and hash."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.rows)


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes, or of one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def words(column, letters: np.ndarray, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of every whole text of the column, a chunk of rows at a time."""
    data, offsets = text_column(column)
    for lo, hi in chunks(offsets, size):
        part = data[offsets[lo]:offsets[hi]]
        if lower:
            part = part + ((part - np.uint8(65) < 26).view(np.uint8) << 5)  # A to Z
        inside = letters[part]
        bounds = offsets[lo:hi + 1] - offsets[lo]
        fresh = np.zeros(len(part) + 1, bool)
        fresh[bounds] = True
        starts, ends = inside.copy(), inside.copy()
        if len(part):
            starts[1:] &= ~inside[:-1] | fresh[1:-1]
            ends[:-1] &= ~inside[1:] | fresh[1:-1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        doc = np.searchsorted(bounds[1:], starts, side="right")
        yield Words(lo, hi, part, starts, ends, doc, run_hashes(_VALUES[part], starts, ends))


def release() -> None:
    """Give memory that a task no longer needs back to the machine: its worker process stays for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than GNU's
        pass


def append_columns(df, fn: Callable, fields: list[tuple[str, str]]):
    """``df`` with more columns, which ``fn`` makes of each Arrow batch (a column of the same name is replaced).

    ``fn`` gets a RecordBatch and returns a list of arrays, one for each of ``fields`` (name, SQL type).
    """
    from pyspark.sql.types import StructType

    new = [n for n, _ in fields]
    kept = df.drop(*[c for c in df.columns if c in new])
    extra = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields))
    schema = StructType(kept.schema.fields + extra.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *fn(batch)], names=[*batch.schema.names, *new])
        release()

    return kept.mapInArrow(run, schema)
