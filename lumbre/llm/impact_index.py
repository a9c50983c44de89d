"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are dealt into shards.  A shard holds for each dimension its postings in the order of their component, cut into
segments of one quantised level with the least and greatest component of each.  A query multiplies these by its own component:
the segment's impact, the most that it adds to a score.  Segments of all dimensions are processed by descending impact, adding
to accumulators.  What a candidate has not been seen in can add at most the impact of the next segment, for each dimension; so
candidates whose accumulator plus that bound stays below the k-th best exact score so far are out.  Processing stops only on
this proof: when the candidates that it leaves are few enough to be scored exactly, or nothing is left to process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbre.llm import vectors
from lumbre.session import cut_lineage

#: levels of a dimension, queries that meet a shard in one task, rounds in which postings are processed
LEVELS, QUERIES, ROUNDS = 32, 512, 12
#: a shard's candidates that may be left to exact scoring: this many, or this share
FEW, SHARE = 64, 1 / 6
INDEX = f"shard long, {vectors.BLOCK}, postings binary, starts binary, least binary, most binary"


def segments(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings of each dimension by ascending component; starts of segments (dims x levels + 1), their least and greatest component."""
    n, dims = cells.shape
    order = np.argsort(cells, axis=0, kind="stable").T
    starts = np.zeros((dims, LEVELS + 1), np.int64)
    least, most = np.zeros((dims, LEVELS)), np.zeros((dims, LEVELS))
    for d in range(dims):
        values = cells[order[d], d]
        edges = values[0] + (values[-1] - values[0]) * (np.arange(1, LEVELS) / LEVELS)
        starts[d, 1:-1], starts[d, -1] = np.searchsorted(values, edges, "right"), n
        full = np.flatnonzero(np.diff(starts[d]))
        least[d, full], most[d, full] = values[starts[d, full]], values[starts[d, full + 1] - 1]
    return order.astype("<i4"), starts, least, most


def build(rows: DataFrame, count: int, scale: float, size: int = vectors.ROWS) -> DataFrame:
    """The index table: a row for each shard of about ``size`` vectors."""
    def run(table: pa.Table) -> pa.Table:
        ids, labels, cells = vectors.block(table, scale)
        kind, dims, data = vectors.pack(cells)
        parts = [np.ascontiguousarray(p).tobytes() for p in segments(cells)]
        values = [table.column("shard")[0].as_py(), ids.tobytes(), labels.tobytes(), kind, dims, data, *parts]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.binary(), *[pa.binary()] * 4]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["shard", "ids", "labels", "kind", "dims", "cells", "postings", "starts", "least", "most"])
    n = vectors.blocks_for(count, size)
    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("shard").applyInArrow(run, INDEX)


class Shard:
    """An index row in memory."""

    def __init__(self, row: dict):
        self.ids, self.cells = vectors.longs(row["ids"]), vectors.unpack(row)
        n, dims = self.cells.shape
        self.postings = np.frombuffer(row["postings"], "<i4").reshape(dims, n)
        self.starts = np.frombuffer(row["starts"], np.int64).reshape(dims, LEVELS + 1)
        self.least, self.most = (np.frombuffer(row[c], np.float64).reshape(dims, LEVELS) for c in ("least", "most"))
        self.sizes = np.diff(self.starts, axis=1)
        self.exact = None

    def scores(self, query: np.ndarray, members: np.ndarray | slice) -> np.ndarray:
        """Exact scores; whole numbers too large for doubles are multiplied as Python's."""
        if float(np.abs(query).max(initial=0)) * max(float(np.abs(self.least).max(initial=0)), float(np.abs(self.most).max(initial=0))) * len(query) * 128 < 2.0 ** 53:
            return self.cells[members] @ query
        if self.exact is None:
            self.exact = np.frompyfunc(int, 1, 1)(self.cells).astype(object)
        return vectors.within_longs(self.exact[members] @ np.frompyfunc(int, 1, 1)(query).astype(object))

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places of the ``k`` best candidates other than ``own``, their scores, and how many postings were processed."""
        n, dims = self.cells.shape
        query = query[:dims] if len(query) >= dims else np.pad(query, (0, dims - len(query)))
        taking = np.flatnonzero(query)
        mine = np.searchsorted(self.ids, own)
        mine = int(mine) if mine < n and self.ids[mine] == own else -1
        few = max(FEW, 4 * k, int(n * SHARE))
        best, floor, seen = np.zeros(0, np.int64), -np.inf, 0
        if n <= few or not len(taking):
            members = np.arange(n)
        else:
            q = query[taking, None]
            impact = np.where(q > 0, q * self.most[taking], q * self.least[taking])
            sizes = self.sizes[taking]
            slack = 1e-9 * float(np.abs(impact).max(axis=1).sum())
            order = np.argsort(np.where(sizes > 0, -impact, np.inf), axis=None, kind="stable")[:np.count_nonzero(sizes)]
            ends = np.cumsum(sizes.ravel()[order])
            total, count, done, members = np.zeros(n), np.zeros(n, np.int64), np.zeros(len(taking), np.int64), None
            for cut in np.unique(np.searchsorted(ends, ends[-1] * np.arange(3, ROUNDS + 1) / ROUNDS) + 1):
                cut = min(int(cut), len(order))
                until = np.bincount(order[:cut] // LEVELS, weights=sizes.ravel()[order[:cut]], minlength=len(taking)).astype(np.int64)
                touched = np.flatnonzero(until > done)
                if len(touched):
                    up = query[taking[touched]] > 0
                    a, b = np.where(up, n - until[touched], done[touched]), np.where(up, n - done[touched], until[touched])
                    where = np.concatenate([self.postings[d, x:y] for d, x, y in zip(taking[touched].tolist(), a.tolist(), b.tolist())])
                    inside = (self.starts[taking[touched], :-1] >= a[:, None]) & (self.starts[taking[touched], 1:] <= b[:, None])
                    total += np.bincount(where, np.repeat(impact[touched][inside], sizes[touched][inside]), n)
                    count += np.bincount(where, minlength=n)
                done, seen = until, int(until.sum())
                ahead = float(impact.ravel()[order[cut]]) if cut < len(order) else 0.0
                bound = total + (len(taking) - count) * ahead + slack
                tried = np.union1d(best, np.argpartition(bound, n - 4 * k)[n - 4 * k:])
                tried = tried[tried != mine]
                told = self.scores(query, tried)
                if len(tried) >= k:
                    floor = max(floor, float(np.sort(told)[-k]) - slack)
                best = tried[np.argsort(-told, kind="stable")[:k]]
                members = np.flatnonzero(bound >= floor)
                if len(members) <= few:
                    break
        members = members[members != mine]
        scores = self.scores(query, members)
        order = np.lexsort((self.ids[members], -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(members)), key=lambda i: (-scores[i], self.ids[members[i]]))[:k], np.int64)
        return members[order], scores[order], seen


def search(index: DataFrame, queries: DataFrame, n_shards: int, n_queries: int, scale: float, k: int) -> DataFrame:
    """``k`` best of each query (``id``, ``label``, ``vector``): query_id, rank, vec_id, score.

    Blocks of queries meet every shard, each pair in one task that holds one shard and one block.
    """
    n_blocks = vectors.blocks_for(n_queries, QUERIES)
    asked = vectors.packed(queries, n_queries, scale, QUERIES, "block").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, object]] = []
        if left.num_rows and right.num_rows:
            row = right.to_pylist()[0]
            shard = Shard(left.to_pylist()[0])
            for own, query in zip(vectors.longs(row["ids"]), vectors.unpack(row)):
                members, scores, _ = shard.top(query, own, k)
                found += [(own, shard.ids[m], s) for m, s in zip(members, scores)]
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": vectors.as_longs([f[2] for f in found])})

    near = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def topk(df: DataFrame, asks: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0, size: int = vectors.ROWS) -> DataFrame:
    """The ``k`` rows with the highest inner product for each row for which ``asks`` (a condition on ``id``) holds, itself apart.

    Components are multiplied by ``scale`` and floored, so products are exact; ties go to the smaller id.  Rows with a null id or
    vector, or a component that is null or not finite, take no part; of rows that repeat an id one counts; vectors of different
    length compare as if zeros followed; an empty table gives no rows.  Scores beyond 64 bits count as the end of that range.
    """
    count = df.count()
    rows = cut_lineage(vectors.participants(df, id_column, vector, scale), "vectors")
    queries = rows.where(asks)
    index = cut_lineage(build(rows, count, scale, size), "impact-index")
    return search(index, queries, vectors.blocks_for(count, size), queries.count(), scale, k)
