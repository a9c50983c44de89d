"""Date formats, epochs and zones."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, functions as F

DEFAULT_ZONE = "America/Argentina/Buenos_Aires"

DateFormat = namedtuple("DateFormat", "name shape pattern zoned")

# Fixed values, in the order they are tried: the first format that reads every
# value wins, so day-first comes before month-first.
DATE_FORMATS = (
    DateFormat("ISO8601", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?", None, True),
    DateFormat("yyyy-MM-dd HH:mm:ss.SSS", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}", "yyyy-MM-dd HH:mm:ss.SSS", False),
    DateFormat("yyyy-MM-dd HH:mm:ss", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "yyyy-MM-dd HH:mm:ss", False),
    DateFormat("yyyy-MM-dd HH:mm", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}", "yyyy-MM-dd HH:mm", False),
    DateFormat("yyyy-MM-dd", r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd", False),
    DateFormat("yyyy/MM/dd HH:mm:ss", r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}", "yyyy/MM/dd HH:mm:ss", False),
    DateFormat("yyyy/MM/dd", r"\d{4}/\d{2}/\d{2}", "yyyy/MM/dd", False),
    DateFormat("dd/MM/yyyy HH:mm:ss", r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}", "dd/MM/yyyy HH:mm:ss", False),
    DateFormat("dd/MM/yyyy HH:mm", r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}", "dd/MM/yyyy HH:mm", False),
    DateFormat("dd/MM/yyyy", r"\d{2}/\d{2}/\d{4}", "dd/MM/yyyy", False),
    DateFormat("d/M/yyyy H:mm:ss", r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}", "d/M/yyyy H:mm:ss", False),
    DateFormat("d/M/yyyy H:mm", r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}", "d/M/yyyy H:mm", False),
    DateFormat("d/M/yyyy", r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy", False),
    DateFormat("MM/dd/yyyy HH:mm:ss", r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}", "MM/dd/yyyy HH:mm:ss", False),
    DateFormat("MM/dd/yyyy HH:mm", r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}", "MM/dd/yyyy HH:mm", False),
    DateFormat("MM/dd/yyyy", r"\d{2}/\d{2}/\d{4}", "MM/dd/yyyy", False),
    DateFormat("dd-MM-yyyy HH:mm:ss", r"\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2}", "dd-MM-yyyy HH:mm:ss", False),
    DateFormat("dd-MM-yyyy", r"\d{2}-\d{2}-\d{4}", "dd-MM-yyyy", False),
    DateFormat("yyyyMMdd-HH:mm:ss.SSS", r"\d{8}-\d{2}:\d{2}:\d{2}\.\d{3}", "yyyyMMdd-HH:mm:ss.SSS", False),
    DateFormat("yyyyMMdd-HH:mm:ss", r"\d{8}-\d{2}:\d{2}:\d{2}", "yyyyMMdd-HH:mm:ss", False),
    DateFormat("yyyyMMddHHmmssSSS", r"\d{17}", "yyyyMMddHHmmss.SSS", False),
    DateFormat("yyyyMMddHHmmss", r"\d{14}", "yyyyMMddHHmmss", False),
)
BY_NAME = {f.name: f for f in DATE_FORMATS}
DAY_ONLY = ("yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy")

# Shapes of an epoch in milliseconds and in seconds.
EPOCHS = (("UNIX_MS", r"1\d{12}"), ("UNIX", r"1\d{9}"))


def parse(c: Column, name: str, zone: str | None = None) -> Column:
    """The timestamp (UTC), NULL when the text does not follow the format.

    ``zone`` is the zone of texts that do not carry their own.
    """
    text = F.trim(c)
    if name in ("UNIX", "UNIX_MS"):
        number = text.try_cast("bigint")
        return F.timestamp_millis(number if name == "UNIX_MS" else number * 1000)
    fmt = BY_NAME[name]
    if name == "ISO8601":
        ts = text.try_cast("timestamp")
        local = ~text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
        if zone:
            ts = F.when(local, F.to_utc_timestamp(ts, zone)).otherwise(ts)
    else:
        if name == "yyyyMMddHHmmssSSS":
            # The parser cannot split adjacent seconds and millis by itself.
            text = F.regexp_replace(text, r"^(\d{14})(\d{3})$", "$1.$2")
        ts = F.try_to_timestamp(text, F.lit(fmt.pattern))
        if zone:
            ts = F.to_utc_timestamp(ts, zone)
    in_range = ts.between(F.lit("1970-01-01").cast("timestamp"), F.lit("2100-12-31 23:59:59.999999").cast("timestamp"))
    # One condition inside the other: sides of an AND count as always evaluated when Spark looks for what is used twice, so every text would be parsed.
    return F.when(F.trim(c).rlike(f"^(?:{fmt.shape})$"), F.when(in_range, ts))


def parse_first(c: Column, names: list[str], zone: str | None = None) -> Column:
    """First format of the list that reads the value."""
    return F.coalesce(*[parse(c, n, zone) for n in names])


def parse_pattern(c: Column, *patterns: str, zone: str | None = None) -> Column:
    ts = F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in patterns])
    return F.to_utc_timestamp(ts, zone) if zone else ts


def merge_date_time(day: Column, clock: Column, day_format: str, zone: str | None = None) -> Column:
    """One timestamp out of a date column and a clock column."""
    joined = F.concat_ws(" ", F.trim(day), F.trim(clock))
    return parse_pattern(joined, f"{day_format} H:mm:ss", f"{day_format} H:mm", zone=zone)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def to_user_zone(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def from_user_zone(ts: Column, zone: str) -> Column:
    return F.to_utc_timestamp(ts.cast("timestamp"), zone)


def month_key(ts: Column) -> Column:
    """``yyyy_MM`` in UTC: the partition a row belongs to."""
    return F.date_format(ts, "yyyy_MM")


def months_between(first: str, last: str) -> Column:
    """Array of ``yyyy_MM`` keys from one ``yyyy-MM`` month to another."""
    days = F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("interval 1 month"))
    return F.transform(days, lambda d: F.date_format(d, "yyyy_MM"))
