"""Catalogue of known line formats: how to spot each one and which columns it yields."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lumbre.functions import dates
from lumbre.functions.nested import nest, pairs_to_map
from lumbre.plans import fix, keyvalue
from lumbre.plans.grok import grok


@dataclass(frozen=True)
class LineFormat:
    name: str
    shape: str                                   # regex a line of the format satisfies
    patterns: tuple[str, ...]                    # alternatives, first match wins
    fields: tuple[tuple[str, str, str], ...]     # (capture, dotted output path, type)
    time: str = ""                               # capture holding the event time
    time_patterns: tuple[str, ...] = ()
    extension: str = ""                          # capture holding key=value pairs
    extension_fields: tuple[tuple[str, str, str], ...] = field(default=())


# Public line formats and the standard names of their fields.
_HTTP = (("clientip", "source.ip", "string"), ("ident", "user.id", "string"), ("auth", "user.name", "string"),
         ("verb", "http.request.method", "string"), ("request", "url.original", "string"),
         ("httpversion", "http.version", "string"), ("response", "http.response.status_code", "bigint"),
         ("bytes", "http.response.body.bytes", "bigint"))
_CLF = r'^\S+ \S+ \S+ \[\d{1,2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}[^\]]*\] "[^"]*" \d+ \S+'
_LEVELS = "TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|SEVERE|FINE|FINER|FINEST|CONFIG"

CATALOGUE = (
    LineFormat(
        "cef", r"^CEF:\d+\|",
        (r"CEF:%{INT:cef_version}\|%{DATA:device_vendor}\|%{DATA:device_product}\|%{DATA:device_version}\|"
         r"%{DATA:signature_id}\|%{DATA:name}\|%{DATA:severity}\|%{GREEDYDATA:cef_extension}$",),
        (("cef_version", "labels.cef_version", "string"), ("device_vendor", "observer.vendor", "string"),
         ("device_product", "observer.product", "string"), ("device_version", "observer.version", "string"),
         ("signature_id", "event.code", "string"), ("name", "event.name", "string"),
         ("severity", "event.severity", "bigint")),
        extension="cef_extension",
        extension_fields=(
            ("src", "source.ip", "string"), ("dst", "destination.ip", "string"), ("spt", "source.port", "bigint"),
            ("dpt", "destination.port", "bigint"), ("suser", "source.user.name", "string"),
            ("duser", "destination.user.name", "string"), ("shost", "source.hostname", "string"),
            ("dhost", "destination.hostname", "string"), ("proto", "network.protocol", "string"),
            ("act", "event.action", "string"), ("msg", "message", "string"), ("rt", "event.created", "string"),
            ("cs1", "labels.cs1", "string"), ("cs2", "labels.cs2", "string"), ("in", "source.bytes", "bigint"),
            ("out", "destination.bytes", "bigint"))),
    LineFormat(
        "syslog_5424", r"^<\d+>1 \d{4}-\d{2}-\d{2}T",
        (r"<%{POSINT:syslog_pri}>%{POSINT:syslog_ver} %{TIMESTAMP_ISO8601:event_timestamp} %{IPORHOST:syslog_host} "
         r"%{DATA:syslog_app} %{DATA:syslog_pid} %{DATA:syslog_msgid} %{GREEDYDATA:syslog_msg}$",),
        (("syslog_pri", "log.syslog.priority", "bigint"), ("syslog_host", "host.hostname", "string"),
         ("syslog_app", "process.name", "string"), ("syslog_pid", "process.pid", "string"),
         ("syslog_msgid", "event.id", "string"), ("syslog_msg", "message", "string")),
        time="event_timestamp", time_patterns=("ISO8601",)),
    LineFormat(
        "syslog_3164", r"^(?:<\d+>)?\w{3}\s+\d{1,2} \d{2}:\d{2}:\d{2} ",
        (r"^(?:<%{NONNEGINT:priority}>)?%{SYSLOGTIMESTAMP:timestamp} %{SYSLOGHOST:logsource}(?: %{SYSLOGPROG}:|) "
         r"?%{GREEDYDATA:message}$",),
        (("priority", "log.syslog.priority", "bigint"), ("logsource", "host.hostname", "string"),
         ("program", "process.name", "string"), ("pid", "process.pid", "string"), ("message", "message", "string")),
        time="timestamp", time_patterns=("MMM d HH:mm:ss",)),
    LineFormat(
        "syslog_iso", r"^(?:<\d+>)?\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})? "
                      r"\S+ [^\s:\[]+(?:\[\d+\])?: ",
        (r"^(?:<%{POSINT:syslog_pri}>)?%{TIMESTAMP_ISO8601:event_timestamp} %{IPORHOST:syslog_host} "
         r"%{DATA:syslog_app}(?:\[%{POSINT:syslog_pid}\])?: %{GREEDYDATA:syslog_msg}$",),
        (("syslog_pri", "log.syslog.priority", "bigint"), ("syslog_host", "host.hostname", "string"),
         ("syslog_app", "process.name", "string"), ("syslog_pid", "process.pid", "string"),
         ("syslog_msg", "message", "string")),
        time="event_timestamp", time_patterns=("ISO8601",)),
    LineFormat(
        "apache_combined", _CLF + r' "[^"]*" "[^"]*"\s*$', ("%{COMBINEDAPACHELOG}",),
        _HTTP + (("referrer", "http.request.referrer", "string"), ("agent", "user_agent.original", "string")),
        time="timestamp", time_patterns=("dd/MMM/yyyy:HH:mm:ss Z",)),
    LineFormat(
        "apache_common", _CLF + r"\s*$", ("%{COMMONAPACHELOG}",), _HTTP,
        time="timestamp", time_patterns=("dd/MMM/yyyy:HH:mm:ss Z",)),
    LineFormat(
        "log4j", rf"^\[\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}[.,]\d+\]\s+(?:{_LEVELS})\b",
        (r"\[%{DATA:event_timestamp}\]\s+%{LOGLEVEL:log_level}\s+-\s+\[%{DATA:thread_name}\]\s+%{DATA:log_origin}:\s+"
         r"%{GREEDYDATA:event_message}$",
         r"\[%{DATA:event_timestamp}\]\s+%{LOGLEVEL:log_level}\s+\[%{DATA:thread_name}\]\s+%{DATA:log_origin}\s+-\s+"
         r"%{GREEDYDATA:event_message}$",
         r"\[%{DATA:event_timestamp}\]\s+%{LOGLEVEL:log_level}\s+%{GREEDYDATA:event_message}$"),
        (("log_level", "log.level", "string"), ("thread_name", "process.thread.name", "string"),
         ("log_origin", "log.origin.function", "string"), ("event_message", "event.original", "string")),
        time="event_timestamp",
        time_patterns=("yyyy-MM-dd HH:mm:ss,SSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss.SSS")),
)
BY_NAME = {f.name: f for f in CATALOGUE}


def _time(c: Column, fmt: LineFormat, year: int | None, zone: str | None) -> Column:
    if fmt.time_patterns == ("ISO8601",):
        return dates.parse(c, "ISO8601", zone)
    if fmt.name == "syslog_3164":
        # The text has no year; the caller supplies it.
        squeezed = F.regexp_replace(c, r"\s+", " ")
        return dates.parse_pattern(F.concat_ws(" ", F.lit(str(year or 1970)), squeezed), "yyyy MMM d HH:mm:ss", zone=zone)
    return dates.parse_pattern(c, *fmt.time_patterns, zone=None if fmt.time_patterns[0].endswith("Z") else zone)


def parse_lines(lines: DataFrame, name: str, value: str = "value", year: int | None = None,
                zone: str | None = None) -> DataFrame:
    """Nested columns under standard names, ``@timestamp``, and ``parse_errors`` for lines that do not fit.

    A line that does not fit is kept in ``raw_line``, so that it can be parsed again; extension keys without a standard name
    are kept in the map ``extension_other``.
    """
    fmt = BY_NAME[name]
    kept = [c for c in lines.columns if c != value]
    df = lines.withColumn("_m", grok(F.trim(F.col(value)), list(fmt.patterns)))
    out: dict[str, Column] = {}
    for captured, path, dtype in fmt.fields:
        c = F.col(f"_m.{captured}")
        if captured in ("referrer", "agent"):
            c = keyvalue.unquote(c)
        out[path] = c.try_cast(dtype) if dtype != "string" else c
    if fmt.extension:
        df = df.withColumn("_kv", _extension(F.col(f"_m.{fmt.extension}")))
        for key, path, dtype in fmt.extension_fields:
            c = F.try_element_at(F.col("_kv"), F.lit(key))
            out[path] = c.try_cast(dtype) if dtype != "string" else c
        mapped = [key for key, _, _ in fmt.extension_fields]
        other = [F.map_filter("_kv", lambda k, v: ~k.isin(*mapped)).alias("extension_other")]
    else:
        other = []
    if "log.syslog.priority" in out:
        out["log.syslog.facility.code"] = F.floor(out["log.syslog.priority"] / 8).cast("bigint")
        out["log.syslog.severity.code"] = out["log.syslog.priority"] % 8
    failed = F.array_compact(F.array(F.when(F.col("_m").isNull(), F.lit("_grokparsefailure"))))
    stamped = [_time(F.col(f"_m.{fmt.time}"), fmt, year, zone).alias("@timestamp")] if fmt.time else []
    raw = F.when(F.size(failed) > 0, F.col(value)).alias("raw_line")
    return df.select(*kept, *stamped, *nest(out), *other, raw, failed.alias("parse_errors"))


def _extension(c: Column) -> Column:
    """CEF pairs: a value runs, blanks included, until the next key."""
    rx = r"(\w+)=((?:(?!\s+\w+=)[\s\S])*)"
    return pairs_to_map(F.regexp_extract_all(c, F.lit(rx), 1), F.regexp_extract_all(c, F.lit(rx), 2))


def detect(c: Column) -> Column:
    """Name of the first format of the catalogue the line satisfies, NULL if none."""
    line = F.trim(c)
    chain = F.when(fix.has_message(line) & line.rlike(fix.ANY_ENVELOPE), F.lit("fix"))
    for fmt in CATALOGUE:
        chain = chain.when(line.rlike(fmt.shape), F.lit(fmt.name))
    return chain


def vote(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row with the format most lines satisfy and its share."""
    counted = lines.groupBy(detect(F.col(value)).alias("format")).count()
    return counted.agg(F.max_by("format", F.when(F.col("format").isNotNull(), F.struct("count", "format"))).alias("format"),
                       (F.max(F.when(F.col("format").isNotNull(), F.col("count"))) / F.sum("count")).alias("share"))


def looks_like_csv(lines: DataFrame, first: str, value: str = "value") -> DataFrame:
    """One row ``is_csv``: three commas or more in the first line, about as many (±2) in half of the rest."""
    commas = first.count(",")
    if "=" in first or commas < 3:
        return lines.sparkSession.sql("SELECT false AS is_csv")
    n = F.length(F.regexp_replace(F.col(value), "[^,]", ""))
    near = (F.trim(F.col(value)) != "") & (F.abs(n - commas) <= 2)
    rest = F.col(value) != first
    return lines.agg((F.count_if(rest & near) >= F.greatest(F.lit(1), F.floor(F.count_if(rest) / 2))).alias("is_csv"))


def source_of(c: Column) -> Column:
    """Which of the four native security sources a line comes from."""
    return F.when(c.rlike("^date="), F.lit("fortigate")).when(c.rlike("^<[0-9]+>"), F.lit("auth")) \
        .when(c.contains("trace_name"), F.lit("cloudaudit")).when(c.contains("attack"), F.lit("waf"))


def ssh_fields(message: Column, program: Column) -> dict[str, Column]:
    """What a login or sudo message says: action, outcome, user, address, technique and campaign."""
    failed, accepted = message.rlike("^Failed password"), message.rlike("^Accepted password")
    user = F.when(failed, F.regexp_extract(message, r"for (?:invalid user )?([a-zA-Z0-9._-]+) from", 1)) \
        .when(accepted, F.regexp_extract(message, r"for ([a-zA-Z0-9._-]+) from", 1))
    return {
        "event.action": F.when(failed | accepted, F.lit("ssh_login")).when(program == "sudo", F.lit("sudo")),
        "event.outcome": F.when(failed, F.lit("failure")).when(accepted, F.lit("success")),
        "user.name": F.nullif(user, F.lit("")),
        "source.ip": F.when(failed | accepted, F.nullif(F.regexp_extract(message, r"from (\S+)", 1), F.lit(""))),
        "security.denied": F.when(failed, F.lit("1")),
        "event.technique": F.nullif(F.regexp_extract(message, r"technique=(\S+)", 1), F.lit("")),
        "event.campaign": F.nullif(F.trim(F.regexp_extract(message, r"campaign=(\S+)", 1)), F.lit("")),
    }
