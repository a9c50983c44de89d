"""Ordered per-key scans that never hold a whole key in one task.

A window partitioned by the key alone puts every row of a hot key on one
executor. Here the window is partitioned by (key, chunk), with the chunk a
coarse slice of the order; each chunk then receives what the chunks before it
carried, from a table of one row per chunk. Callers aggregate rows with equal
(key, order) first, so a chunk is bounded by the resolution of the order and
not by the volume of data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def chunked_scan(df: DataFrame, keys: list[str], order: str, chunk: Column, **scans: tuple[str, str]) -> DataFrame:
    """Add a running value per entry of ``scans``: name → (kind, column).

    ``sum``   running sum, current row included;
    ``last``  last non-null value so far, current row included;
    ``prev``  last non-null value before the current row;
    ``max``   largest value before the current row.
    Rows of one key must have distinct ``order`` values for ``prev`` and ``last``.
    """
    df = df.withColumn("_chunk", chunk)
    local = Window.partitionBy(*keys, "_chunk").orderBy(order)
    upto, before = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(Window.unboundedPreceding, -1)
    local_of = {
        "sum": lambda c: F.sum(c).over(upto),
        "last": lambda c: F.last(c, ignorenulls=True).over(upto),
        "prev": lambda c: F.last(c, ignorenulls=True).over(before),
        "max": lambda c: F.max(c).over(before),
    }
    whole_of = {
        "sum": lambda c: F.sum(c),
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))),
        "prev": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))),
        "max": lambda c: F.max(c),
    }
    rows = df.withColumns({f"_l_{n}": local_of[kind](c) for n, (kind, c) in scans.items()})
    chunks = df.groupBy(*keys, "_chunk").agg(*[whole_of[kind](c).alias(f"_w_{n}") for n, (kind, c) in scans.items()])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    over_of = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True),
               "prev": lambda c: F.last(c, ignorenulls=True)}
    carried = chunks.select(*keys, "_chunk", *[over_of[kind](f"_w_{n}").over(earlier).alias(f"_c_{n}")
                                               for n, (kind, _) in scans.items()])
    joined = rows.join(carried, [*keys, "_chunk"])
    final = {}
    for n, (kind, _) in scans.items():
        here, past = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if kind == "sum":
            final[n] = F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0))
        elif kind == "max":
            final[n] = F.greatest(here, past)
        else:
            final[n] = F.coalesce(here, past)
    return joined.select(*[c for c in df.columns if c != "_chunk"], *[c.alias(n) for n, c in final.items()])


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_chunk(us: Column, seconds: int = 3600) -> Column:
    return F.floor(us / F.lit(seconds * 1_000_000))


def sequence_gaps(df: DataFrame, keys: list[str], seq: str, chunk_size: int = 100_000) -> DataFrame:
    """Numbers missing before each sequence number of a key (first of a key: no row). Only the gaps."""
    distinct = df.where(F.col(seq).isNotNull()).select(*keys, seq).distinct().withColumn("_v", F.col(seq))
    scanned = chunked_scan(distinct, keys, seq, F.floor(F.col(seq) / chunk_size), previous=("prev", "_v"))
    return scanned.where(F.col(seq) - F.col("previous") > 1) \
        .select(*keys, "previous", seq, (F.col(seq) - F.col("previous") - 1).alias("missing"))


def out_of_order(df: DataFrame, keys: list[str], arrival: str, ts: str, chunk_size: int = 100_000) -> DataFrame:
    """Rows that arrived after a later one of their key: ``ts`` below the maximum already seen.

    ``arrival`` is the unique arrival number within the key.
    """
    us = df.where(F.col(ts).isNotNull()).withColumn("_us", micros(F.col(ts)))
    scanned = chunked_scan(us, keys, arrival, F.floor(F.col(arrival) / chunk_size), _seen=("max", "_us"))
    late = F.col("_seen") > F.col("_us")
    return scanned.where(late).withColumn("late_ms", F.round((F.col("_seen") - F.col("_us")) / 1000).cast("bigint")).drop("_seen", "_us")


def sequence_numbers(df: DataFrame, keys: list[str], ts: str, tie: str, reset: Column, step: Column) -> DataFrame:
    """Running number per key that restarts where ``reset`` holds; idle rows may consume more than one (``step``).

    The order is (ts, tie), which must be unique within a key.
    """
    us = micros(F.col(ts))
    rows = df.withColumns({"_us": us, "_o": F.struct(us.alias("us"), F.col(tie).alias("tie")), "_step": step.cast("bigint"), "_reset": reset})
    totals = chunked_scan(rows, keys, "_o", time_chunk(F.col("_us")), _run=("sum", "_step"))
    totals = totals.withColumn("_base", F.when(F.col("_reset"), F.col("_run") - F.col("_step")))
    based = chunked_scan(totals, keys, "_o", time_chunk(F.col("_us")), _start=("last", "_base"))
    return based.withColumn("sequence", F.col("_run") - F.coalesce("_start", F.lit(0))) \
        .drop("_us", "_step", "_reset", "_o", "_run", "_base", "_start")
