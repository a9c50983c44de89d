"""Counts over the whole corpus, brought back to the documents that need them.

Documents are hashed into buckets of bounded size.  A bucket sends each different key (a 64-bit hash) once, with its
count, to the key's range; a range adds up what it got and returns the totals in the order they came.  So a key that a
third of all documents hold costs one entry a bucket, no task sees all rows of a key, and no row is paired with another.
The documents are shuffled once: every step that needs them reads the same exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 2000
NOTES = "bucket long, range long, keys binary, counts binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("range", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def bucketed(df: DataFrame, key: str, text: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, int]:
    """``df`` with a ``bucket`` by hash of key and text, and the number of buckets (it grows with the rows)."""
    n = max(1, math.ceil(df.count() / rows_per_bucket))
    return df.withColumn("bucket", F.pmod(F.xxhash64(key, text), F.lit(n))), n


def noted(bucket: int, keys: np.ndarray, counts: np.ndarray, ranges: int, passenger: bytes | None = None) -> pa.Table:
    """Sorted keys cut at the range borders; a passenger travels under a range of its own and is handed on as it is."""
    place = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    used = np.unique(place)
    cuts = np.append(np.searchsorted(place, used), len(keys))
    rows = [(bucket, int(r), keys[a:b].tobytes(), numbers(counts[a:b])) for r, a, b in zip(used, cuts[:-1], cuts[1:])]
    if passenger is not None:
        rows.append((bucket, -1 - bucket, b"", passenger))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, _SCHEMA.types)], schema=_SCHEMA)


def numbers(values: np.ndarray) -> bytes:
    """Whole numbers of up to 64 bits in as few bytes each as the largest needs, which the first byte says."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def read_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint64) if data else np.zeros(0, np.uint64)


def unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def bucket_of(table: pa.Table) -> int:
    return table.column("bucket")[0].as_py()


def send(docs: DataFrame, keys: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], ranges: int) -> DataFrame:
    """First step: the (sorted, different) keys of each bucket and their counts."""
    return docs.groupBy("bucket").applyInArrow(lambda t: noted(bucket_of(t), *keys(t), ranges), NOTES)


def send_on(docs: DataFrame, notes: DataFrame, keys: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]], ranges: int) -> DataFrame:
    """A later step: the keys that depend on the totals before, which travel on with them."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SCHEMA.empty_table()
        totals, _ = received(right)
        return noted(bucket_of(left), *keys(left, totals), ranges, numbers(totals))
    return docs.groupBy("bucket").cogroup(notes.groupBy("bucket")).applyInArrow(run, NOTES)


def add_up(sent: DataFrame, shapes: int = 0) -> DataFrame:
    """Totals of each range, returned to the buckets: ``counts`` is aligned with the keys sent, which are not repeated.

    With ``shapes``, a range's first row has in ``keys`` the sum of totals and the number of different keys with a total for each
    value of a key modulo ``shapes`` (read with ``statistics``).
    """
    def run(table: pa.Table) -> pa.Table:
        if table.column("range")[0].as_py() < 0:
            return table
        blobs = [np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist()]
        counts = np.concatenate([read_numbers(b) for b in table.column("counts").to_pylist()])
        keys, sizes = np.concatenate(blobs), [len(b) for b in blobs]
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(counts[order], first) if len(keys) else counts
        total = np.empty(len(keys), np.uint64)
        total[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
        ends = np.cumsum(sizes)
        told = [b""] * len(sizes)
        if shapes:
            shape, counted = (ordered[first] % np.uint64(shapes)).astype(np.int64), sums > 0
            told[0] = np.stack([np.bincount(shape, weights=w, minlength=shapes) for w in (sums, counted)], axis=1).astype(">i8").tobytes()
        return pa.table([table.column("bucket"), table.column("range"), pa.array(told, pa.binary()),
                         pa.array([numbers(total[e - s:e]) for s, e in zip(sizes, ends)], pa.binary())], schema=_SCHEMA)
    return sent.groupBy("range").applyInArrow(run, NOTES)


def statistics(keys):
    """Array of (``shape``, ``n``: sum of totals, ``v``: different keys) out of the bytes that ``add_up`` left in ``keys``."""
    number = lambda i: F.conv(F.hex(F.substring(keys, i * 8 + 1, 8)), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), (F.length(keys) / 16).cast("int") - 1), lambda i: F.struct(i.alias("shape"), number(i * 2).alias("n"), number(i * 2 + 1).alias("v")))


def received(notes: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
    """Totals in the order of the keys sent, and the passenger."""
    parts = sorted(zip(notes.column("range").to_pylist(), notes.column("counts").to_pylist()))
    totals = [read_numbers(b) for r, b in parts if r >= 0]
    before = [read_numbers(b) for r, b in parts if r < 0]
    return np.concatenate(totals) if totals else np.zeros(0, np.uint64), before[0] if before else None


def deliver(docs: DataFrame, notes: DataFrame, fn: Callable[[pa.Table, np.ndarray, np.ndarray | None], Iterable], schema: str) -> DataFrame:
    """Last step: the rows of each bucket with the totals of its keys."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, *received(right))
    return docs.groupBy("bucket").cogroup(notes.groupBy("bucket")).applyInArrow(run, schema)
