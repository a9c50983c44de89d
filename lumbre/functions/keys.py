"""Document keys, fingerprints and masking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def fingerprint(*columns: Column, sep: str = "|") -> Column:
    """SHA-256 over the concatenated sources: the document id of an idempotent write."""
    return F.sha2(F.concat_ws(sep, *[c.cast("string") for c in columns]), 256)


def composite_key(*columns: Column) -> Column:
    """``session:sequence``; NULL if any part is missing."""
    present = columns[0].isNotNull()
    for c in columns[1:]:
        present = present & c.isNotNull()
    return F.when(present, F.concat_ws(":", *[c.cast("string") for c in columns]))


def masked(c: Column) -> Column:
    """Unreadable but still groupable and countable."""
    return F.sha2(c.cast("string"), 256)


def row_uuid(*columns: Column) -> Column:
    """A UUID that the columns alone decide (version 5 form over SHA-256), so a row keeps it in every run."""
    h = F.substring(fingerprint(*columns), 1, 32)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def prune(df: DataFrame, keep: list[str], drop: list[str] = ()) -> DataFrame:
    """Only columns whose name holds one of the regular expressions ``keep`` and none of ``drop``."""
    fits = lambda n, rules: any(re.search(r, n) for r in rules)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if fits(c, keep) and not fits(c, drop)])


def in_share(share: float, *columns: Column) -> Column:
    """Whether a row is in a share of all rows that its key alone decides, so that it is the same in every run and plan."""
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") < share * (1 << 32)
