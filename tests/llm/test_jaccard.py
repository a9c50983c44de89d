import random

import numpy as np
import pytest

from lumbre.llm import jaccard
from lumbre.llm.components import components
from tests.llm.brute import groups


def corpus():
    pick, rows = random.Random(7), []
    passage = [f"p{i}" for i in range(30)]
    for n in range(12):
        base = [f"b{n}w{i}" for i in range(pick.choice([3, 6, 40, 150, 400]))] + (passage if n % 2 else [])
        for _ in range(pick.randint(1, 9)):
            copy = list(base)
            for _ in range(pick.randint(0, max(1, len(copy) // 60))):
                copy[pick.randrange(len(copy))] = f"e{pick.random()}"
            rows.append((pick.randint(0, 500), " ".join(copy)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "Tiny"), (1004, "tiny"), (None, "tiny"), (1003, "Tiny")]


@pytest.mark.parametrize("shard", [2, 2000])
def test_brute_force(spark, shard):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.near_duplicates(docs, rows_per_bucket=10, shard=shard).collect()
    key = lambda x: repr(x)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(((k, *g) for (k, _), g in zip(rows, groups(rows))), key=key)


def test_trees_lose_no_pair():
    pick = np.random.default_rng(3)
    base = [np.unique(pick.integers(1, 1 << 60, 80, dtype=np.uint64)) for _ in range(15)]
    sets = [np.unique(np.concatenate([b[pick.random(len(b)) > 0.08], pick.integers(1, 1 << 60, 4, dtype=np.uint64)])) for b in base for _ in range(6)]
    like = lambda a, b: 100 * (o := len(np.intersect1d(a, b))) >= 80 * (len(a) + len(b) - o)
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if like(sets[i], sets[j])}
    tree = jaccard.Tree(sets)
    got = {tuple(sorted(p)) for i, j in jaccard.candidate_pairs(tree, tree, 80, block=50) for p in zip(i.tolist(), j.tolist())}
    assert want and want <= got and len(got) < 1000
    half = jaccard.Tree(sets[:40]), jaccard.Tree(sets[40:])
    across = {(x, y + 40) for i, j in jaccard.candidate_pairs(*half, 80) for x, y in zip(i.tolist(), j.tolist())}
    assert {(i, j) for i, j in want if i < 40 <= j} <= across


def test_one_of_each(spark, odd, no_rows):
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(map(repr, [1, 2, 3, 4, 5, None, 7, 8, 8]))
    assert jaccard.one_of_each(no_rows).collect() == [] and jaccard.near_duplicates(no_rows).collect() == []


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    root = {r["node"]: r["root"] for r in got}
    assert len({root[i] for i in range(61)}) == 1 and len({root[i] for i in range(100, 150)}) == 1 and len(set(root.values())) == 2
