import random

import pytest

from lumbre.llm import substrings
from tests.llm.brute import repeats


@pytest.mark.parametrize("window", [1, 2, 5, 6, 35])
def test_brute_force(spark, window):
    pick = random.Random(window)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(pick.choice("abcdefgh") + str(pick.randint(0, 9 if window < 10 else 999)) for _ in range(pick.randint(0, 80))) for _ in range(60)]
    texts += [" ".join(passage), "x " + " ".join(passage[5:50]), "z " * 100, None, "", "é " * 40, texts[0], "  \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = repeats(texts, window)
    for r in substrings.mark_repeats(docs, window=window, rows_per_bucket=9).collect():
        assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]]


def test_odd_rows(odd, no_rows):
    got = substrings.mark_repeats(odd)
    assert [c for c in got.columns if c not in ("n_words", "n_removed", "kept")] == [c for c in odd.columns if c != "kept"]
    rows = got.collect()
    assert len(rows) == odd.count() and all(r["n_removed"] in (0, 60) for r in rows if r["doc_id"] in (1, 6, 9))
    assert substrings.mark_repeats(no_rows).collect() == []


def test_longest_repeats_double_until_none_is_left(spark):
    base = [f"w{i}" for i in range(50)]
    texts = [" ".join(base), "a " + " ".join(base[:23]), " ".join(f"v{i}" for i in range(50)), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["longest"] for r in substrings.longest_repeats(docs, window=5, rows_per_bucket=2).collect()}
    assert got == {0: 20, 1: 20, 2: 0, 3: 0}
