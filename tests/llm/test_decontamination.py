import random

import pytest

from lumbre.llm import decontamination
from tests.llm.brute import hits


@pytest.mark.parametrize("block", [30, 1_000_000])
def test_brute_force(spark, block):
    pick = random.Random(5)
    word = lambda: pick.choice(["The", "cat", "sat", "on", "a", "mat", "été", "42"])
    items = [" ".join(word() for _ in range(pick.randint(0, 14))) for _ in range(30)] + [None, "", "sat", "!!"]
    texts = [" ".join(word() for _ in range(pick.randint(0, 60))) for _ in range(60)] + [items[0] + ", " + items[1], None, "", "cat" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = decontamination.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), window=5, block_words=block).collect()
    want = hits(texts, items, 5)
    assert len(found) == len(texts)
    for r in found:
        n, hit, ids = want[r["doc_id"]]
        assert (r["n_words"], sum(s["length"] for s in r["spans"]), set(r["items"])) == (n, hit, ids)
        assert r["longest"] == max([s["length"] for s in r["spans"]], default=0)


def test_odd_rows(spark, odd, no_rows):
    bench = spark.createDataFrame([(1, " ".join(f"same{i}" for i in range(20))), (2, None), (2, "")], "item_id long, text string")
    found = decontamination.contaminated(odd, bench).collect()
    assert len(found) == odd.count() and sum(bool(r["spans"]) for r in found) == 4
    kept = decontamination.decontaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert decontamination.decontaminated(odd, bench.limit(0)).count() == odd.count()
    assert decontamination.contaminated(no_rows, bench).collect() == []
