"""Lookups and time joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumbre.functions import net
from lumbre.operators.scan import chunked_scan, micros, time_chunk


def lookup(facts: DataFrame, dimension: DataFrame, on, columns: list[str]) -> DataFrame:
    """Left join to one row per key. Whether the dimension is broadcast is left to its measured size."""
    return facts.join(dimension.select(*({on} if isinstance(on, str) else set(on)), *columns), on, "left")


def correlate_aggregates(df: DataFrame, key: str, left: Column, right: Column, left_name: str, right_name: str) -> DataFrame:
    """Keys with rows on both sides of one table, and how many on each.

    Both counts come from one scan and one aggregation: the equi-join of two
    filtered aggregations of the same table is the set of keys where both are positive.
    """
    return df.where((left | right) & F.col(key).isNotNull()).groupBy(key) \
        .agg(F.count_if(left).alias(left_name), F.count_if(right).alias(right_name)) \
        .where((F.col(left_name) > 0) & (F.col(right_name) > 0))


def window_matches(left: DataFrame, right: DataFrame, key: str, ts: str, seconds: int, before: bool = True, weight: str | None = None) -> DataFrame:
    """Per distinct (key, time) of ``left``: how many rows of ``right`` lie within the window around it.

    ``weight`` names a column that says for how many rows a row stands.

    No pair of rows is ever formed: the count is the difference of two running
    counts, read at the two ends of the window. ``before=False`` only looks forward.
    """
    # Both ends of the window are included; a probe sorts after (end) or before (start) the events of its instant.
    span = seconds * 1_000_000
    at = lambda d: d.where(F.col(key).isNotNull() & F.col(ts).isNotNull()) \
        .groupBy(F.col(key), micros(F.col(ts)).alias("us")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    events = at(right).select(key, (F.col("us") * 3 + 1).alias("o"), F.col("n"), F.lit(None).cast("bigint").alias("origin"),
                              F.lit(0).alias("sign"), F.lit(0).cast("bigint").alias("n_left"))
    start = F.col("us") - (span if before else 0)
    probes = at(left).select(key, F.explode(F.array(
        F.struct((start * 3).alias("o"), F.lit(-1).alias("sign")),
        F.struct(((F.col("us") + span) * 3 + 2).alias("o"), F.lit(1).alias("sign")))).alias("p"),
        F.col("us").alias("origin"), F.col("n").alias("n_left")) \
        .select(key, F.col("p.o").alias("o"), F.lit(0).cast("bigint").alias("n"), "origin", F.col("p.sign").alias("sign"), "n_left")
    scanned = chunked_scan(events.unionByName(probes), [key], "o", F.floor(F.col("o") / (3 * 3600 * 1_000_000)), run=("sum", "n"))
    return scanned.where(F.col("origin").isNotNull()).groupBy(key, "origin") \
        .agg(F.max("n_left").alias("n_left"), F.sum(F.col("run") * F.col("sign")).alias("n_right")) \
        .where(F.col("n_right") > 0) \
        .select(key, F.timestamp_micros("origin").alias(ts), "n_left", "n_right")


def correlate_within(left: DataFrame, right: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """Per key, findings of each kind that have one of the other within the window."""
    matched = window_matches(left, right, key, ts, minutes * 60)
    return matched.groupBy(key).agg(F.sum("n_left").alias("left_findings"), F.sum(F.col("n_left") * F.col("n_right")).alias("matches"),
                                    F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))


def correlate_sources(sources: dict[str, DataFrame], key: str, ts: str, minutes: int = 60, limit: int | None = None) -> DataFrame:
    """All pairs of sources (the first ``limit`` if given), each correlated in time and labelled."""
    names = list(sources)
    couples = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]][:limit]
    return reduce(DataFrame.unionByName, [
        correlate_within(sources[a], sources[b], key, ts, minutes).withColumn("pair", F.lit(f"{a}-{b}")) for a, b in couples])


def nearest(probes: DataFrame, series: DataFrame, keys: list[str], ts: str, value: str, tolerance_us: int) -> DataFrame:
    """Each probe with the value of the closest point of ``series`` (one point per key and time), NULL beyond the tolerance.

    A tie goes to the earlier point. Found by one scan forwards and one
    backwards over the union of both sides, never by pairing them.
    """
    p = probes.where(F.col(ts).isNotNull()).select(*keys, micros(F.col(ts)).alias("us")).distinct() \
        .select(*keys, (F.col("us") * 2 + 1).alias("o"), "us", F.lit(None).cast("struct<us:bigint,v:double>").alias("pt"))
    s = series.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).withColumn("us", micros(F.col(ts))) \
        .select(*keys, (F.col("us") * 2).alias("o"), "us", F.struct("us", F.col(value).cast("double").alias("v")).alias("pt"))
    chunk = F.floor(F.col("o") / (2 * 3600 * 1_000_000))
    forward = chunked_scan(p.unionByName(s), keys, "o", chunk, prior=("last", "pt"))
    backward = chunked_scan(forward.withColumn("o", -F.col("o")), keys, "o", F.floor(F.col("o") / (2 * 3600 * 1_000_000)),
                            following=("last", "pt"))
    d1, d2 = F.col("us") - F.col("prior.us"), F.col("following.us") - F.col("us")
    best = F.when((d1 <= tolerance_us) & ((d1 <= d2) | d2.isNull()), F.col("prior")) \
        .when(d2 <= tolerance_us, F.col("following"))
    found = backward.where(F.col("pt").isNull()).select(*keys, F.col("us").alias("_us"), best.alias("_pt"))
    joined = probes.withColumn("_us", micros(F.col(ts))).join(found, [*keys, "_us"], "left")
    return joined.select(*probes.columns, F.col("_pt.v").alias(f"nearest_{value}"),
                         F.timestamp_micros("_pt.us").alias(f"nearest_{ts}"))


def elapsed(df: DataFrame, keys: list[str], ts: str, start: Column, end: Column) -> DataFrame:
    """End events with the seconds since the latest start of their key (those without one are left out)."""
    us = micros(F.col(ts))
    at = df.where((start | end) & F.col(ts).isNotNull()).groupBy(*keys, us.alias("us")) \
        .agg(F.bool_or(start).alias("s"), F.count_if(end).alias("ends"))
    # A start and an end at the same instant: the end belongs to the start.
    marked = at.withColumn("begun", F.when(F.col("s"), F.col("us")))
    scanned = chunked_scan(marked, keys, "us", time_chunk(F.col("us")), since=("last", "begun"))
    return scanned.where((F.col("ends") > 0) & F.col("since").isNotNull()) \
        .select(*keys, F.timestamp_micros("us").alias(ts), "ends", ((F.col("us") - F.col("since")) / 1e6).alias("elapsed_s"))


def flag_listed(df: DataFrame, column: str, listed: DataFrame, list_column: str, flag: str = "matched") -> DataFrame:
    """``flag`` is true when the value is in the list: a left join to its distinct values."""
    values = listed.select(F.col(list_column).alias(column)).where(F.col(column).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return df.join(values, column, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def geoip(df: DataFrame, ip: str, ranges: DataFrame, columns: list[str]) -> DataFrame:
    """IPv4 → place, from a table of disjoint ranges (``start``, ``end`` numbers).

    Distinct addresses (2^32 at most) and range starts are scanned together,
    sliced by the address's first 16 bits; the result joins back by address.
    """
    number = net.ipv4_number(F.col(ip))
    place = F.struct(F.col("end"), *[F.col(c) for c in columns])
    starts = ranges.select(F.col("start").cast("bigint").alias("n"), place.alias("place"), F.lit(0).alias("probe"))
    wanted = df.select(number.alias("n")).where(F.col("n").isNotNull()).distinct() \
        .select("n", F.lit(None).cast(starts.schema["place"].dataType).alias("place"), F.lit(1).alias("probe"))
    both = starts.unionByName(wanted).withColumn("o", F.col("n") * 2 + F.col("probe"))
    scanned = chunked_scan(both, [], "o", F.floor(F.col("n") / 65536), hit=("last", "place"))
    found = scanned.where((F.col("probe") == 1) & (F.col("hit.end") >= F.col("n"))) \
        .select(F.col("n").alias("_n"), *[F.col(f"hit.{c}").alias(c) for c in columns])
    return df.withColumn("_n", number).join(found, "_n", "left").drop("_n")


def address_places(df: DataFrame, ip: str, ranges: DataFrame, columns: list[str]) -> DataFrame:
    """Address of either kind → place, from a table of disjoint ranges (``start`` and ``end`` as address texts).

    Distinct addresses and range starts are scanned together as 16-byte keys, sliced by their first four bytes (IPv4 ones by the
    first two of theirs); the result joins back by key.
    """
    key = net.address_key
    place = F.struct(key(F.col("end")).alias("end"), *[F.col(c) for c in columns])
    starts = ranges.select(key(F.col("start")).alias("n"), place.alias("place"), F.lit(0).alias("probe")).where(F.col("n").isNotNull())
    wanted = df.select(key(F.col(ip)).alias("n")).where(F.col("n").isNotNull()).distinct() \
        .select("n", F.lit(None).cast(starts.schema["place"].dataType).alias("place"), F.lit(1).alias("probe"))
    both = starts.unionByName(wanted).withColumn("o", F.concat(F.col("n"), F.when(F.col("probe") == 1, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))))
    part = F.when(F.substring("n", 1, 4) == F.unhex(F.lit("00000000")), F.substring("n", 1, 14)).otherwise(F.substring("n", 1, 4))
    scanned = chunked_scan(both, [], "o", part, hit=("last", "place"))
    found = scanned.where((F.col("probe") == 1) & (F.col("hit.end") >= F.col("n"))) \
        .select(F.col("n").alias("_n"), *[F.col(f"hit.{c}").alias(c) for c in columns])
    return df.withColumn("_n", key(F.col(ip))).join(found, "_n", "left").drop("_n")


def share_found(judged: DataFrame, texts: DataFrame, text: str, id_column: str) -> DataFrame:
    """Judged rows with the id of their text, and one way to see how many have one."""
    ids = texts.groupBy(text).agg(F.min(id_column).alias(id_column))
    return judged.join(ids, text, "left").withColumn("found", F.col(id_column).isNotNull())
