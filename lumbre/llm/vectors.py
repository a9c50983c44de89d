"""Vectors as exact integers: the rows that take part, packed blocks, inner products without rounding."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: vectors in one packed block
ROWS = 8192
BLOCK = "ids binary, labels binary, kind string, dims int, cells binary"


def participants(df: DataFrame, id_column: str, vector: str, scale: float, label: Column | None = None) -> DataFrame:
    """(``id``, ``label``, ``vector``) of the rows that take part, one for each id.

    A row with a null id, a null vector, or a component that is null or not finite once scaled takes no part; nor, if a ``label``
    is given, does one without label.  Of rows that repeat an id, the greatest by label and vector stands for all.
    """
    scaled = lambda x: F.abs(x.cast("double") * F.lit(float(scale)))
    fine = F.forall(vector, lambda x: x.isNotNull() & (scaled(x) < F.lit(math.inf)))
    rows = df.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & fine & (F.lit(True) if label is None else label.isNotNull()))
    label = F.lit(0) if label is None else label
    rows = rows.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("vector"))
    return rows.groupBy("id").agg(F.max(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")


def blocks_for(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def matrix(column, scale: float) -> np.ndarray:
    """Scaled and floored components as a float array; vectors that are shorter than the longest one are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    counts = np.diff(column.offsets.to_numpy())
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    width = int(counts.max()) if len(counts) else 0
    if len(counts) and counts.min() == width:
        return values.reshape(len(counts), width)
    out = np.zeros((len(counts), width))
    out[np.repeat(np.arange(len(counts)), counts), np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)] = values
    return out


def pack(cells: np.ndarray) -> tuple[str, int, bytes]:
    """The smallest type that holds whole numbers of this size."""
    most = np.abs(cells).max() if cells.size else 0
    kind = next((k for k, m in (("<i1", 1 << 7), ("<i2", 1 << 15), ("<i4", 1 << 31)) if most < m), "<f8")
    return kind, cells.shape[1], cells.astype(kind).tobytes()


def unpack(row: dict) -> np.ndarray:
    n = len(row["ids"]) // 8
    return np.frombuffer(row["cells"], row["kind"]).astype(np.float64).reshape(n, row["dims"])


def longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def block(table: pa.Table, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in ascending order, their labels and cells."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order].astype("<i8"), table.column("label").to_numpy()[order].astype("<i8"), matrix(table.column("vector"), scale)[order]


def packed(rows: DataFrame, count: int, scale: float, size: int = ROWS, name: str = "shard") -> DataFrame:
    """Rows dealt by a hash of their id into blocks of about ``size``, one row for each block."""
    n = blocks_for(count, size)

    def run(table: pa.Table) -> pa.Table:
        ids, labels, cells = block(table, scale)
        kind, dims, data = pack(cells)
        return pa.table({name: pa.array([table.column(name)[0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "labels": pa.array([labels.tobytes()], pa.binary()),
                         "kind": [kind], "dims": pa.array([dims], pa.int32()), "cells": pa.array([data], pa.binary())})
    return rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n))).groupBy(name).applyInArrow(run, f"{name} long, {BLOCK}")


def same_width(*parts: np.ndarray) -> list[np.ndarray]:
    width = max(p.shape[1] for p in parts)
    return [np.pad(p, ((0, 0), (0, width - p.shape[1]))) if p.shape[1] < width else p for p in parts]


def exact(*parts: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are if doubles hold 128 times any inner product of theirs exactly, else as Python's whole numbers."""
    most = [float(np.abs(p).max()) if p.size else 0.0 for p in parts]
    if max(most) ** 2 * max(p.shape[1] for p in parts) * 128 < 2.0 ** 53:
        return list(parts)
    return [np.frompyfunc(int, 1, 1)(p).astype(object) for p in parts]


def within_longs(scores: np.ndarray) -> np.ndarray:
    """Scores beyond the range of 64 bits count as its end (and so tie there)."""
    return np.minimum(np.maximum(scores, -(1 << 63)), (1 << 63) - 1) if scores.dtype == object else scores


def as_longs(scores) -> pa.Array:
    return pa.array([int(s) for s in scores], pa.int64())
