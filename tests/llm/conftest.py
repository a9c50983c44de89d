import pytest

#: names that operators use inside, to show that a table may have them
CLASHES = ("row", "key", "bucket", "t", "class", "score", "spans", "kept", "host", "evidence")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows, names that clash."""
    long = " ".join(f"word{i % 5000}x{i % 7}" for i in range(30_000))
    same = " ".join(f"same{i}" for i in range(60))
    rows = [(1, same), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, same), (1, same), (None, "a null key. " * 3), (7, "é 日本 ß " * 20), (8, "one"), (8, "other words of that key"), (9, same + " and more")]
    return spark.createDataFrame([(*r, *[None] * len(CLASHES)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))


@pytest.fixture(scope="session")
def no_rows(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
