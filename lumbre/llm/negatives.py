"""Hard negatives by anchors on a spanning tree.

Anchors are dealt into blocks of near ones, and a block is joined by a minimum spanning tree.  Down an edge of the tree the score of
a candidate changes by no more than the edge's length times the candidate's norm, so the score (or its bounds) at the parent
gives bounds at the child.  Only candidates whose bounds meet a window of the child are scored again, exactly.  The window is
first what beats the positives found so far, then, once positives are known, the band of scores below each of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lumbre.llm import vectors
from lumbre.session import cut_lineage

#: anchors in a block, pivots (a bounded sample of anchors) that say which are near, candidates looked at together
ANCHORS, PIVOTS, TOGETHER = 256, 32, 4096
TREE = f"block long, {vectors.BLOCK}, visit binary, parent binary, edge binary"


def spanning_tree(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's tree: the order of visits, and the parent (-1 at the root) and edge length of each row."""
    n = len(cells)
    squares = (cells ** 2).sum(axis=1)
    parent, away, out = np.full(n, -1), np.full(n, np.inf), np.ones(n, bool)
    visit, at = np.zeros(n, np.int64), 0
    for i in range(n):
        visit[i], out[at] = at, False
        gap = np.sqrt(np.maximum(squares + squares[at] - 2 * (cells @ cells[at]), 0))
        closer = out & (gap < away)
        away[closer], parent[closer] = gap[closer], at
        if i + 1 < n:
            at = int(np.argmin(np.where(out, away, np.inf))) if np.isfinite(away[out]).any() else int(np.flatnonzero(out)[0])
    edge = np.zeros(n)
    has = parent >= 0
    edge[has] = np.linalg.norm(cells[has] - cells[parent[has]], axis=1)
    return visit, parent, edge


def trees(anchors: DataFrame, scale: float) -> tuple[DataFrame, int]:
    """A row for each block of near anchors with its tree, and the number of blocks."""
    pivots = [r.vector for r in anchors.orderBy(F.xxhash64("id")).select("vector").limit(PIVOTS).collect()]
    width = max((len(p) for p in pivots), default=0)
    points = np.floor(np.array([[*p, *[0.0] * (width - len(p))] for p in pivots], np.float64).reshape(len(pivots), width) * scale)

    def nearest(batches):
        for batch in batches:
            if batch.num_rows:
                cells, centres = vectors.same_width(vectors.matrix(batch.column("vector"), scale), points)
                gaps = (centres ** 2).sum(axis=1)[None, :] - 2 * cells @ centres.T
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gaps.argmin(axis=1), pa.int32())], names=[*batch.schema.names, "cell"])

    dealt = cut_lineage(anchors.mapInArrow(nearest, StructType([*anchors.schema.fields, StructField("cell", IntegerType())])), "anchors")
    sizes = {r.cell: r.n for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each pivot at most
    parts = {c: vectors.blocks_for(n, ANCHORS) for c, n in sizes.items()}
    first = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist()))
    total = max(1, sum(parts.values()))
    lookup = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in (d or {0: 1}).items() for x in kv]), F.col("cell"))
    blocks = dealt.withColumn("block", (lookup(first) + F.pmod(F.xxhash64("id"), lookup(parts))).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        ids, labels, cells = vectors.block(table, scale)
        kind, dims, data = vectors.pack(cells)
        visit, parent, edge = spanning_tree(cells)
        values = [table.column("block")[0].as_py(), ids.tobytes(), labels.tobytes(), kind, dims, data, visit.astype("<i8").tobytes(), parent.astype("<i8").tobytes(), edge.tobytes()]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int32(), *[pa.binary()] * 4]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["block", "ids", "labels", "kind", "dims", "cells", "visit", "parent", "edge"])
    return cut_lineage(blocks.groupBy("block").applyInArrow(run, TREE), "anchor-trees"), total


def walk(tree: dict, shard: dict, windows, found) -> None:
    """Visit the anchors of a block from the root, over the candidates of a shard.

    ``windows(a)`` gives the least and greatest score of each window of anchor ``a`` as two arrays (none: nothing is asked);
    ``found(a, places, scores)`` gets exactly scored candidates, all that lie in a window among them.
    """
    anchors, cells = vectors.same_width(vectors.unpack(tree), vectors.unpack(shard))
    visit, parent = vectors.longs(tree["visit"]), vectors.longs(tree["parent"])
    edge = np.frombuffer(tree["edge"], np.float64)
    norms = np.sqrt((cells ** 2).sum(axis=1))
    anchors, cells = vectors.exact(anchors, cells)
    children = np.bincount(parent[parent >= 0], minlength=len(anchors))
    for a in range(0, len(cells), TOGETHER):
        part, norm = cells[a:a + TOGETHER], norms[a:a + TOGETHER]
        known: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        for at in visit:
            at, up = int(at), int(parent[at])
            if up < 0:
                low, high = np.full(len(part), -np.inf), np.full(len(part), np.inf)
            else:
                below, above, left = known.pop(up)
                if left > 1:
                    known[up] = (below, above, left - 1)
                reach = norm * (edge[at] * (1 + 1e-9)) + 1e-9 * (1 + np.abs(below))
                low, high = below - reach, above + reach
            least, most = windows(at)
            meets = np.zeros(len(part), bool)
            for x, y in zip(least, most):
                meets |= (high >= x) & (low <= y)
            if up < 0:
                meets[:] = True  # the root's scores are all exact
            places = np.flatnonzero(meets)
            if len(places):
                scores = (part if len(places) == len(part) else part[places]) @ anchors[at]
                low[places] = high[places] = scores.astype(np.float64)
                found(at, places + a, vectors.within_longs(scores))
            if children[at]:
                known[at] = (low, high, int(children[at]))


def first(places: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """(-score, id) of the first ``k`` by score, ties to smaller ids (ids ascend with places)."""
    if len(places) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k] if scores.dtype != object else sorted(scores)[-k]
        keep = np.flatnonzero(scores >= cut)
        places, scores = places[keep], scores[keep]
    return sorted(zip((-scores).tolist(), ids[places].tolist()))[:k]


def beats(have, k: int) -> float:
    """The least score that may still come among the first ``k``, a little below what the last of them has."""
    return -np.inf if len(have) < k else -have[-1][0] - 1 - 1e-9 * abs(have[-1][0])


def meet(tree: DataFrame, shards: DataFrame, n_blocks: int, n_shards: int):
    left = tree.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
    right = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard"))


def positives(tree: DataFrame, shards: DataFrame, n_blocks: int, n_shards: int, k: int) -> DataFrame:
    """The first ``k`` other rows of the anchor's label: block, anchor_id, positive_id, positive_score."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        best: dict[int, list] = {}
        if left.num_rows and right.num_rows:
            t, s = left.to_pylist()[0], right.to_pylist()[0]
            ids, labels, own, kinds = vectors.longs(s["ids"]), vectors.longs(s["labels"]), vectors.longs(t["ids"]), vectors.longs(t["labels"])

            def windows(a):
                return [beats(best.get(a, ()), k)], [np.inf]

            def found(a, places, scores):
                same = (labels[places] == kinds[a]) & (ids[places] != own[a])
                if same.any():
                    best[a] = sorted(best.get(a, []) + first(places[same], scores[same], ids, k))[:k]
            walk(t, s, windows, found)
        rows = [(left.column("block")[0].as_py(), int(own[a]), i, -s) for a, have in best.items() for s, i in have]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), vectors.as_longs([r[3] for r in rows])],
                        names=["block", "anchor_id", "positive_id", "positive_score"])

    near = meet(tree, shards, n_blocks, n_shards).applyInArrow(run, "block long, anchor_id long, positive_id long, positive_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    return near.withColumn("n", rank).where(F.col("n") <= k).drop("n")


def negatives(tree: DataFrame, shards: DataFrame, chosen: DataFrame, n_blocks: int, n_shards: int, k: int, least: int) -> DataFrame:
    """For each anchor and positive the first ``k`` rows of another label with ``least`` * positive <= 100 * score <= 100 * positive."""
    told = chosen.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score"))).alias("chosen"))  # k for each anchor of a block

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        best: dict[tuple[int, int], list] = {}
        pairs: dict[int, list] = {}
        if left.num_rows and right.num_rows:
            t, s = left.to_pylist()[0], right.to_pylist()[0]
            ids, labels, own, kinds = vectors.longs(s["ids"]), vectors.longs(s["labels"]), vectors.longs(t["ids"]), vectors.longs(t["labels"])
            at = {int(x): i for i, x in enumerate(own)}
            for p in t["chosen"] or ():
                pairs.setdefault(at[p["anchor_id"]], []).append((p["positive_id"], p["positive_score"]))

            def windows(a):
                low = []
                for p, score in pairs.get(a, ()):
                    have = best.get((a, p), ())
                    low.append(max(least * score / 100 - 1, beats(have, k)))
                return low, [np.inf if score == (1 << 63) - 1 else score * (1 + 1e-12) + 1 for _, score in pairs.get(a, ())]

            def found(a, places, scores):
                other = labels[places] != kinds[a]
                places, scores = places[other], scores[other]
                for p, score in pairs.get(a, ()):
                    fits = (scores * 100 >= least * score) & (scores <= score)
                    if fits.any():
                        best[a, p] = sorted(best.get((a, p), []) + first(places[fits], scores[fits], ids, k))[:k]
            walk(t, s, windows, found)
        rows = [(int(own[a]), p, i, next(x for q, x in pairs[a] if q == p), -s) for (a, p), have in best.items() for s, i in have]
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) if i < 3 else vectors.as_longs([r[i] for r in rows]) for i in range(5)],
                        names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    near = meet(tree.join(told, "block", "left"), shards, n_blocks, n_shards).applyInArrow(run, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(df: DataFrame, label: Column, asks: Column, id_column: str = "vec_id", vector: str = "embedding", positives_each: int = 5, negatives_each: int = 5,
         least: int = 80, scale: float = 256.0, size: int = vectors.ROWS) -> DataFrame:
    """Hard negatives of the anchors (rows for whose ``id`` the condition ``asks`` holds).

    An anchor's positives are its first other rows of the same label; for each, the first rows of another label whose score is at
    least ``least`` per cent of the positive's and no higher than it.  Order is by score (inner product of scaled, floored
    vectors), ties to the smaller id.  Rows with a null id, label or vector, or a component that is null or not finite, take no
    part; of rows that repeat an id the greatest by label and vector counts; shorter vectors are followed by zeros; an anchor
    without positives, or a positive without negatives, gives no rows, nor does an empty table.  Scores beyond 64 bits count as
    the end of that range.
    """
    count = df.count()
    rows = cut_lineage(vectors.participants(df, id_column, vector, scale, label), "vectors")
    tree, n_blocks = trees(rows.where(asks), scale)
    shards = cut_lineage(vectors.packed(rows, count, scale, size), "shards")
    n_shards = vectors.blocks_for(count, size)
    chosen = cut_lineage(positives(tree, shards, n_blocks, n_shards, positives_each), "positives")
    return negatives(tree, shards, chosen, n_blocks, n_shards, negatives_each, least)
