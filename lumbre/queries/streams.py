"""The streaming jobs run once over a driver table; their result must equal the batch answer."""

import datetime as dt

from pyspark.sql import functions as F

from lumbre.functions.dates import iso
from lumbre.functions.keys import fingerprint
from lumbre.queries.registry import query
from lumbre.queries.security import RULES, _FINDINGS
from lumbre.session import scratch_path
from lumbre.sources import readers, sinks
from lumbre.sources.keyed import KeyedTable
from lumbre.streaming import carried, jobs

FMT = "'%Y-%m-%d %H:%M:%S'"


def _stream(t):
    return jobs.event_stream(t.spark, t.base, "events", t.events.schema)


@query("X1 X2 X4 K2", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_dedup(t):
    copies = _stream(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("id", fingerprint(F.col("event_id"), F.col("user_id")))
    out = jobs.run_once(jobs.dedup(copies, "id", "ts").select("event_id"), scratch_path(t.spark, "dedup"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("X6 X8 X9 A23", f"""SELECT strftime(date_trunc('hour', ts), {FMT}) AS hour, event_type, count(*) AS events, round(sum(value), 2) AS value_sum FROM events GROUP BY 1, 2""")
def stream_hourly_rollup(t):
    out = jobs.run_once_latest(jobs.hourly_rollup(_stream(t), "ts", ["event_type"], ["value"]), scratch_path(t.spark, "rollup"), ["hour", "event_type"])
    return out.select(iso(F.col("hour")).alias("hour"), "event_type", "events", F.round("value_sum", 2).alias("value_sum"))


@query("X10", f"""SELECT strftime(start, {FMT}) AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts) - INTERVAL 2 HOUR, date_trunc('hour', ts) - INTERVAL 3 HOUR]) AS start FROM events) GROUP BY 1""")
def stream_sliding_windows(t):
    out = jobs.run_once_latest(jobs.sliding_sums(_stream(t), "ts", "1 hour", "4 hours", "10 minutes", {"n": F.count(F.lit(1))}), scratch_path(t.spark, "sliding"), ["start", "end"])
    return out.select(iso(F.col("start")).alias("start"), "n")


@query("X5 A21 A22", f"""SELECT user_id AS entity, count(*) AS events, round(sum(value), 2) AS sum_value, round(avg(value), 4) AS avg_value, strftime(max(ts), {FMT}) AS last FROM events GROUP BY 1""")
def stream_entity_profile(t):
    path = scratch_path(t.spark, "profile")
    jobs.for_each_batch(_stream(t), jobs.profile_merger(path, "user_id", "ts", ["value"]), f"{path}__checkpoint").awaitTermination()
    out = jobs.read_profile(t.spark, path, ["value"])
    return out.select("entity", "events", F.round("sum_value", 2).alias("sum_value"), F.round("avg_value", 4).alias("avg_value"), iso(F.col("last")).alias("last"))


@query("X7 A25", "SELECT md5(text) AS digest, count(*) AS count FROM conversations GROUP BY text")
def stream_distinct_texts(t):
    path = scratch_path(t.spark, "texts")
    source = jobs.table_stream(t.spark, t.base, "conversations", t.conversations.schema)
    jobs.for_each_batch(source, jobs.text_merger(path, "text"), f"{path}__checkpoint").awaitTermination()
    from lumbre.sources.sinks import current_table
    return current_table(t.spark, path).select(F.md5("text").alias("digest"), "count")


@query("X11 F13", _FINDINGS)
def stream_rule_findings(t):
    v = F.col("value")
    banded = _stream(t).withColumn("band", F.when(v > 95, F.lit("top")).when(v > 80, F.lit("high")).otherwise(F.lit("low")))
    return jobs.run_once(jobs.rule_findings(banded, RULES).select("event_id", "rule", "level", "severity"), scratch_path(t.spark, "findings"))


@query("X12", f"""SELECT strftime(time_bucket(INTERVAL 10 minutes, ts), {FMT}) AS checked_at, count(*) AS hits FROM events WHERE value >= 70 GROUP BY 1""")
def stream_grade_monitor(t):
    grades = _stream(t).select(F.col("ts").alias("bucket"), (F.col("value") / 100).alias("grade"))
    return jobs.run_once_latest(jobs.high_grades(grades), scratch_path(t.spark, "monitor"), ["checked_at"]).select(iso(F.col("checked_at")).alias("checked_at"), "hits")


_THROTTLED = """WITH RECURSIVE a AS (SELECT DISTINCT event_type AS monitor, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events WHERE value > 80),
r AS (SELECT monitor, min(s) AS s FROM a GROUP BY 1 UNION ALL SELECT r.monitor, (SELECT min(a.s) FROM a WHERE a.monitor = r.monitor AND a.s >= r.s + 3600) FROM r WHERE (SELECT min(a.s) FROM a WHERE a.monitor = r.monitor AND a.s >= r.s + 3600) IS NOT NULL)
SELECT monitor, s FROM r"""


@query("X13", _THROTTLED)
def throttled_alerts(t):
    alerts = t.events.where("value > 80").select(F.col("event_type").alias("monitor"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"))
    return jobs.throttled_alerts(alerts, "monitor", "at").select("monitor", F.unix_seconds("at").alias("s"))


@query("X13", _THROTTLED)
def stream_throttled_alerts(t):
    alerts = _stream(t).where("value > 80").select(F.col("event_type").alias("monitor"), F.date_trunc("second", "ts").alias("at"))
    return jobs.run_once(jobs.throttled_alert_stream(alerts, "monitor", "at"), scratch_path(t.spark, "throttle")).select("monitor", F.unix_seconds("at").alias("s"))


def _drained(t, df, order, action, path: str, pieces: int = 4) -> None:
    """A table that arrives in pieces, in the order of a number: each piece is written in parallel and is one batch of the stream, which goes on after it."""
    arrived = f"{path}/arrivals"
    ends = df.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    cuts = [ends["a"] + (ends["b"] - ends["a"]) * i // pieces for i in range(1, pieces)] if ends["a"] is not None else []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = df.where((F.lit(True) if lo is None else F.col(order) > lo) & (F.lit(True) if hi is None else F.col(order) <= hi))
        part.write.mode("append").parquet(arrived)
        carried.drain(t.spark.readStream.schema(df.schema).parquet(arrived), action, path)


@query("X18 J2", """SELECT e.user_id, strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f') AS at, count(*) AS n_right FROM (SELECT * FROM events WHERE event_type = 'error') e
JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND p.ts BETWEEN e.ts AND e.ts + INTERVAL 1 HOUR GROUP BY 1, 2""")
def stream_correlation(t):
    path, k = scratch_path(t.spark, "correlation"), F.col("event_type")
    rows = t.events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    _drained(t, rows, "us", carried.correlator(t.spark, path, k == "error", k == "purchase", "user_id", "ts", 3600), path)
    found = carried.correlations(t.spark, path, rows.schema, "user_id", "ts", 3600)
    return found.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "n_right")


@query("X16 S14 S16 S3", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, md5(text) AS digest FROM documents")
def stream_multiline(t):
    # lines as a shipper sends them, with source and offset, in files cut inside records
    path = scratch_path(t.spark, "multiline")
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.concat(F.lit("<entry "), F.col("doc_id").cast("string"), F.lit("> "))
    lines = lines.select(F.concat(F.lit("app"), F.pmod("doc_id", F.lit(5)).cast("string")).alias("source"), (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("offset"),
                         F.when(F.col("pos") == 0, F.concat(head, "line")).otherwise(F.col("line")).alias("value"))
    begins = lambda c: c.rlike("^<entry [0-9]+> ")
    _drained(t, lines, "offset", carried.record_assembler(t.spark, path, begins), path)
    found = carried.records(t.spark, path, begins)
    return found.select(F.regexp_extract("value", "^<entry ([0-9]+)> ", 1).cast("bigint").alias("doc_id"), "lines", F.md5(F.regexp_replace("value", "^<entry [0-9]+> ", "")).alias("digest"))


@query("E11 X13 A28", """WITH o AS (SELECT user_id, ts, bool_or(event_type = 'purchase') AS ended, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2),
m AS (SELECT *, lag(ts) OVER w AS before, lag(ended) OVER w AS closed FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(CASE WHEN before IS NULL OR closed OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS task FROM m),
g AS (SELECT user_id, min(ts) AS first, max(ts) AS last, bool_or(ended) AS ended, CAST(sum(n) AS BIGINT) AS events, sum(v) AS v FROM k GROUP BY user_id, task)
SELECT user_id, strftime(first, '%Y-%m-%d %H:%M:%S') AS first, events, round(v, 2) AS value_sum,
  CASE WHEN ended THEN 'ended' WHEN last + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) THEN 'timed_out' ELSE 'open' END AS outcome FROM g""")
def stream_combined_tasks(t):
    path = scratch_path(t.spark, "tasks")
    rows = t.events.select("user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ends = F.col("event_type") == "purchase"
    _drained(t, rows, "us", carried.task_combiner(t.spark, path, "user_id", "ts", ends, ["value"], 6 * 3600), path)
    found = carried.combined_tasks(t.spark, path, rows.schema, "user_id", ["value"])
    return found.select("user_id", iso(F.col("first")).alias("first"), "events", F.round("value_sum", 2).alias("value_sum"), "outcome")


@query("X14", """SELECT strftime(m, '%Y_%m') AS month, date_diff('day', m, DATE '2001-08-15') AS age_days,
CASE WHEN date_diff('day', m, DATE '2001-08-15') >= 121 THEN 'drop' WHEN date_diff('day', m, DATE '2001-08-15') >= 35 THEN 'warm' ELSE 'hot' END AS action
FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders)""")
def retention_plan(t):
    months = t.orders.select(F.date_format("o_orderdate", "yyyy_MM").alias("month")).distinct()
    return jobs.retention_plan(months, dt.date(2001, 8, 15), 90).withColumn("age_days", F.col("age_days").cast("bigint"))


@query("X1 S1", "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events")
def stream_text_ingest(t):
    src, out = scratch_path(t.spark, "arrivals"), scratch_path(t.spark, "ingested")
    t.events.select(F.concat(F.lit("id="), F.col("event_id").cast("string"), F.lit("\r")).alias("value")).write.option("compression", "gzip").text(src)
    parsed = readers.stream_lines(t.spark, src, max_files=2).select(F.regexp_extract("value", r"^id=(\d+)$", 1).try_cast("bigint").alias("id"))
    return jobs.run_once(parsed, out).agg(F.count("id").alias("n"), F.sum("id").alias("ids"))


@query("K2 X5", f"""SELECT user_id, count(*) AS events, round(max(value), 2) AS top, strftime(max(ts), {FMT}) AS last, 0 AS rewritten_elsewhere FROM events GROUP BY 1""")
def keyed_upsert(t):
    # the table is made of all events, then one user's rows come again as a batch that was applied before, then as an empty one
    path = scratch_path(t.spark, "keyed")
    table = KeyedTable(t.spark, path, "user_id", {"events": F.sum, "top": F.max, "last": F.max}, buckets=16)
    rows = t.events.where("user_id IS NOT NULL").select("user_id", F.lit(1).cast("bigint").alias("events"), F.col("value").alias("top"), F.col("ts").cast("timestamp").alias("last"))
    half = F.col("user_id") % 2 == 0
    table.update(rows.where(half), 0)
    table.update(rows.where(~half), 1)
    before = table.manifest()
    one = rows.where(F.col("user_id") == rows.agg(F.min("user_id")).scalar())
    touched = table.update(one, 1) + table.update(one.withColumn("events", F.lit(0).cast("bigint")), 2)
    after = table.manifest()
    moved = sum(after["folders"][b] != folder for b, folder in before["folders"].items()) - len(touched)
    return table.read().select("user_id", "events", F.round("top", 2).alias("top"), iso(F.col("last")).alias("last"), F.lit(moved).alias("rewritten_elsewhere"))


@query("S4 X17", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def jdbc_increments(t):
    # an embedded database that grows between pulls; the second pull dies and is made again
    from lumbre.sources.increments import Increments
    path = scratch_path(t.spark, "increments")
    url, driver = f"jdbc:derby:memory:m{path.rsplit('-', 1)[-1]};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    keys = t.orders.agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b")).first()
    step = None if keys["a"] is None else (keys["b"] - keys["a"]) // 3 + 1
    source = Increments(t.spark, path, url, "ORDERS", "O_ORDERKEY", driver, partitions=4)
    for i in range(3 if step else 0):
        lo = keys["a"] + i * step
        part = t.orders.where((F.col("o_orderkey") >= lo) & (F.col("o_orderkey") < lo + step)).select("o_orderkey", "o_custkey", "o_totalprice")
        sinks.write_jdbc(part.toDF("O_ORDERKEY", "O_CUSTKEY", "O_TOTALPRICE"), url, "ORDERS", driver, connections=2)
        number = source.pull()
        if i == 1:
            source.pull(again=number)
    rows = source.rows()
    return rows.select(*[F.col(c).alias(c.lower()) for c in rows.columns])
