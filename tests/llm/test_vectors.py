"""Exact top-k and hard negatives against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbre.llm import impact_index, negatives, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, id string, shard string, block string, score string, rank string, vector string"


def brute_rows(rows, scale=256):
    """{id: (label, whole numbers)} of the rows that take part."""
    out = {}
    for i, vec, label, *_ in rows:
        if i is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec):
            out[i] = (label, [math.floor(x * scale) for x in vec])
    return out


def product(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), -2**63), 2**63 - 1)


def brute_topk(have, asks, k=5):
    for q in filter(asks, have):
        ranked = sorted((-product(have[q][1], v), i) for i, (_, v) in have.items() if i != q)[:k]
        yield from ((q, r, i, -s) for r, (s, i) in enumerate(ranked, 1))


def brute_mine(have, asks, k=5, least=80):
    have = {i: x for i, x in have.items() if x[0] is not None}
    for a in filter(asks, have):
        label, vec = have[a]
        scored = sorted((-product(vec, v), i, l) for i, (l, v) in have.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            fits = [(-n, i) for n, i, l in scored if l != label and least * -s <= 100 * -n <= 100 * -s][:k]
            yield from ((a, p, r, i, -s, n) for r, (n, i) in enumerate(fits, 1))


def made(kind):
    pick = np.random.default_rng(5)
    if kind == "clusters":  # near anchors, many ties
        centres = pick.normal(size=(6, 8))
        cells = np.round((centres[pick.integers(0, 6, 900)] + pick.normal(size=(900, 8)) * 0.05) * 16) / 16
    elif kind == "spread":
        cells = pick.normal(size=(900, 24))
    else:  # one vector for a third of all rows, and zeros
        cells = pick.normal(size=(900, 12))
        cells[::3], cells[1::90] = cells[0], 0
    return [(i, c.tolist(), int(pick.integers(0, 4)), *[None] * 6) for i, c in enumerate(cells)]


@pytest.mark.parametrize("kind", ["clusters", "spread", "copies"])
def test_whole_tables(spark, kind):
    rows = made(kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = impact_index.topk(df, F.col("id") % 20 == 0, size=300)
    assert sorted(map(tuple, got.collect())) == sorted(brute_topk(brute_rows(rows), lambda i: i % 20 == 0))
    got = negatives.mine(df, F.col("label"), F.col("id") % 20 == 0, size=300)
    assert sorted(map(tuple, got.collect())) == sorted(brute_mine(brute_rows(rows), lambda i: i % 20 == 0))


def odd_rows():
    nan, inf = float("nan"), float("inf")
    vecs = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2), (3, None, 1), (4, [None, 1.0], 1), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [], 1), (8, [3.0], 2),
            (9, [0.5, 1.5, 9.0], 2), (10, [-1.0, -2.0], None), (None, [1.0, 1.0], 1), (20, [1e15, -1e15], 1), (21, [1e15, 1e14], 1), (22, [9e14, 0.25], 2)]
    return [(i, v, label, *["x"] * 6) for i, v, label in vecs]


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([*rows, rows[0]], SCHEMA)  # a repeated row counts once
    pad = {i: (label, v + [0] * (3 - len(v))) for i, (label, v) in brute_rows(rows).items()}
    assert sorted(map(tuple, impact_index.topk(df, F.col("id") % 2 == 0, size=4).collect())) == sorted(brute_topk(pad, lambda i: i % 2 == 0))
    assert sorted(map(tuple, negatives.mine(df, F.col("label"), F.col("id") % 2 == 0, size=4).collect())) == sorted(brute_mine(pad, lambda i: i % 2 == 0))


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert impact_index.topk(df, F.col("id") % 2 == 0).count() == 0
    assert negatives.mine(df, F.col("label"), F.col("id") % 2 == 0).count() == 0


def row(cells):
    ids = np.arange(len(cells), dtype="<i8")
    kind, dims, data = vectors.pack(cells)
    return {"ids": ids.tobytes(), "labels": ids.tobytes(), "kind": kind, "dims": dims, "cells": data}


def test_processing_stops_on_proof():
    """Impacts that differ much end it early, and the result is the whole one."""
    pick = np.random.default_rng(1)
    cells = np.zeros((4000, 40))
    cells[np.arange(4000), pick.integers(0, 40, 4000)] = pick.integers(1, 500, 4000)
    parts = impact_index.segments(cells)
    shard = impact_index.Shard(row(cells) | dict(zip(("postings", "starts", "least", "most"), (p.tobytes() for p in parts))))
    query = np.zeros(40)
    query[:4] = 9, 5, 2, 1
    places, scores, seen = shard.top(query, -1, 5)
    want = sorted(zip(-(cells @ query), range(4000)))[:5]
    assert list(zip(-scores, places)) == want and seen < 4 * 4000 / 2


def test_bounds_spare_candidates():
    """Near anchors share bounds: most candidates are never scored for the children."""
    pick = np.random.default_rng(2)
    centre = pick.normal(size=32) * 256
    anchors, cells = np.round(centre + pick.normal(size=(50, 32)) * 2), np.round(pick.normal(size=(3000, 32)) * 256)
    visit, parent, edge = negatives.spanning_tree(anchors)
    tree = row(anchors) | {"visit": visit.astype("<i8").tobytes(), "parent": parent.astype("<i8").tobytes(), "edge": edge.tobytes()}
    exact = anchors @ cells.T
    low = np.sort(exact, axis=1)[:, -20]
    seen = {}
    negatives.walk(tree, row(cells), lambda a: ([low[a]], [np.inf]), lambda a, places, scores: seen.setdefault(a, []).extend(zip(places, scores)))
    for a in range(50):
        assert {p for p, s in seen[a] if s >= low[a]} == set(np.flatnonzero(exact[a] >= low[a]))
        assert all(exact[a, p] == s for p, s in seen[a])
    assert sum(map(len, seen.values())) < 0.2 * exact.size
    assert sorted(visit) == list(range(50)) and (parent < 0).sum() == 1
