"""What a stream carries from micro-batch to micro-batch, kept as tables.

State that one key may dominate does not fit a keyed state store: all rows of a key meet in one task there.  Here the state is a
table that each micro-batch reads and leaves anew, so the batch operators, which slice hot keys, do the work.  Batch n reads what the
newest complete batch before it left and overwrites what an earlier attempt of itself left, so a replayed batch changes nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumbre.operators import joins, scan
from lumbre.sources import readers
from lumbre.sources.folders import file_system
from lumbre.streaming.jobs import for_each_batch


class Carried:
    """Named tables below ``path``, a folder for each batch that wrote them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def batches(self, name: str) -> list[int]:
        """Numbers of the complete batches that left this table."""
        fs, root = file_system(self.spark, f"{self.path}/{name}")
        if not fs.exists(root):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=")]
        return sorted(int(p.getName()[6:]) for p in found if fs.exists(path(p, "_SUCCESS")))

    def before(self, name: str, batch: int, schema) -> DataFrame:
        """What the newest batch before this one left (nothing at first)."""
        older = [n for n in self.batches(name) if n < batch]
        return self._read(name, older[-1:], schema)

    def newest(self, name: str, schema) -> DataFrame:
        return self._read(name, self.batches(name)[-1:], schema)

    def all(self, name: str, schema) -> DataFrame:
        """What all batches left."""
        return self._read(name, self.batches(name), schema)

    def _read(self, name: str, numbers: list[int], schema) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/batch={n:012d}" for n in numbers])

    def leave(self, name: str, batch: int, df: DataFrame, keep: int | None = None) -> DataFrame:
        """Write this batch's table; with ``keep`` only that many of the newest batches stay."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch:012d}")
        if keep:
            fs, root = file_system(self.spark, f"{self.path}/{name}")
            for n in self.batches(name)[:-keep]:
                fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"batch={n:012d}"), True)
        return self._read(name, [batch], df.schema)

    def clock(self, batch: int) -> dt.datetime | None:
        """The greatest event time of the batches before this one."""
        return self.before("clock", batch, "at timestamp").agg(F.max("at")).first()[0]


def drain(df: DataFrame, action, path: str) -> None:
    """Everything available now through a ``foreachBatch`` action; goes on where an earlier run ended."""
    for_each_batch(df, action, f"{path}/checkpoint").awaitTermination()


# Records over several lines ---------------------------------------------------

RECORD = "{source} string, record string, {value} string, lines bigint, parse_errors array<string>"


def record_assembler(spark: SparkSession, path: str, is_start, source: str = "source", order: str = "offset", value: str = "value", slice_lines: int = 100_000):
    """``foreachBatch`` action: lines (``source``, ``order``, ``value``) become records; the last record of a source stays open until
    its next start arrives, however many batches that takes.

    ``is_start`` makes a condition of the line column.  Lines of a source arrive in the order of ``order`` (an offset), batch after batch.
    Lines before a source's first start are records of their own, flagged.  Work is dealt by source and slice of the order.
    """
    held = Carried(spark, path)
    lines_of = f"{source} string, {order} bigint, {value} string"

    def action(batch: DataFrame, n: int) -> None:
        rows = held.before("open", n, lines_of).unionByName(batch.select(F.col(source).cast("string").alias(source), F.col(order).cast("bigint").alias(order), value))
        starts = rows.groupBy(source).agg(F.max(F.when(is_start(F.col(value)), F.col(order))).alias("_last"))
        split = rows.join(starts, source)
        done = split.where(F.col("_last").isNull() | (F.col(order) < F.col("_last"))).drop("_last")
        held.leave("records", n, assembled(done, is_start, source, order, value, slice_lines))
        held.leave("open", n, split.where(F.col(order) >= F.col("_last")).drop("_last"), keep=2)
    return action


def assembled(lines: DataFrame, is_start, source: str, order: str, value: str, slice_lines: int) -> DataFrame:
    sliced = lines.withColumn("_slice", F.floor(F.col(order) / slice_lines))
    out = readers.assemble_records(sliced, is_start(F.col(value)), [source, "_slice"], order, value)
    return out.select(source, "record", value, F.col("lines").cast("bigint").alias("lines"), "parse_errors")


def records(spark: SparkSession, path: str, is_start, source: str = "source", order: str = "offset", value: str = "value", slice_lines: int = 100_000, open_too: bool = True) -> DataFrame:
    """The records so far; with ``open_too`` what is open counts as ended, as after the last batch."""
    held = Carried(spark, path)
    done = held.all("records", RECORD.format(source=source, value=value))
    if not open_too:
        return done
    rest = held.newest("open", f"{source} string, {order} bigint, {value} string")
    return done.unionByName(assembled(rest, is_start, source, order, value, slice_lines))


# Two streams by time ------------------------------------------------------------

def correlator(spark: SparkSession, path: str, is_left, is_right, key: str, ts: str, seconds: int, before: bool = False, delay: int = 600):
    """``foreachBatch`` action over a stream that holds both kinds: how many right events lie within ``seconds`` of each left one, by key.

    A left event waits until no event within its window can come any more: until the greatest time seen is ``delay`` seconds past
    the window.  Both sides wait as counts by key and time.  Right events leave when no waiting or coming left event can reach them.
    Events that come too late to be counted are kept in the table ``late``.
    """
    held = Carried(spark, path)
    window, late = F.expr(f"interval {seconds} seconds"), F.expr(f"interval {delay} seconds")
    back = window if before else F.expr("interval 0 seconds")
    counts = lambda d: d.groupBy(key, ts).agg(F.sum("n").alias("n"))

    def action(batch: DataFrame, n: int) -> None:
        batch = batch.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
        seen = held.clock(n)
        newest = batch.agg(F.max(ts)).first()[0]
        now = max((x for x in (seen, newest) if x is not None), default=None)
        if now is None:
            return
        schema = sides(batch.schema, key, ts)
        known = F.lit(seen) - window - late if seen is not None else F.lit(None).cast("timestamp")  # lefts up to here are closed
        left_fits, right_fits = (F.lit(True), F.lit(True)) if seen is None else (F.col(ts) > known, F.col(ts) > known - back)
        held.leave("late", n, batch.where((is_left & ~left_fits) | (is_right & ~right_fits)))
        fresh = batch.select(key, F.col(ts).cast("timestamp").alias(ts), F.lit(1).cast("bigint").alias("n"), (is_left & left_fits).alias("_l"), (is_right & right_fits).alias("_r"))
        left = held.leave("left_seen", n, counts(held.before("left", n, schema).unionByName(fresh.where("_l").select(key, ts, "n"))), keep=1)
        right = held.leave("right_seen", n, counts(held.before("right", n, schema).unionByName(fresh.where("_r").select(key, ts, "n"))), keep=1)
        closed = F.col(ts) <= F.lit(now) - window - late
        held.leave("matches", n, matched(left.where(closed), right, key, ts, seconds, before))
        held.leave("left", n, left.where(~closed), keep=2)
        held.leave("right", n, right.where(F.col(ts) > F.lit(now) - window - late - back), keep=2)
        held.leave("clock", n, spark.createDataFrame([(now,)], "at timestamp"), keep=2)
    return action


def sides(schema, key: str, ts: str) -> str:
    return f"{key} {schema[key].dataType.simpleString()}, {ts} timestamp, n bigint"


def matched(left: DataFrame, right: DataFrame, key: str, ts: str, seconds: int, before: bool) -> DataFrame:
    return joins.window_matches(left, right, key, ts, seconds, before, weight="n").select(key, ts, "n_left", "n_right")


def correlations(spark: SparkSession, path: str, schema, key: str, ts: str, seconds: int, before: bool = False) -> DataFrame:
    """Matches so far, those of left events that still wait included (as after the last batch)."""
    held = Carried(spark, path)
    side = sides(schema, key, ts)
    rest = matched(held.newest("left", side), held.newest("right", side), key, ts, seconds, before)
    return held.all("matches", rest.schema).unionByName(rest)


# Tasks that end or time out -----------------------------------------------------

def task_combiner(spark: SparkSession, path: str, key: str, ts: str, ends, measures: list[str], timeout: int, delay: int = 0):
    """``foreachBatch`` action: events of one task combined into one row, until an event for which ``ends`` holds or until ``timeout``
    seconds without an event.

    A task that ended, or that the clock (the greatest time seen less ``delay`` seconds) has timed out, leaves the state and is
    emitted once with its outcome (``ended`` or ``timed_out``).  Events of a task arrive in the order of their times.
    """
    held = Carried(spark, path)

    def action(batch: DataFrame, n: int) -> None:
        seen = held.clock(n)
        newest = batch.agg(F.max(ts)).first()[0]
        now = max((x for x in (seen, newest) if x is not None), default=None)
        if now is None:
            return
        schema = task_schema(batch.schema, key, measures)
        parts = held.before("open", n, schema).unionByName(task_parts(batch, key, ts, ends, measures))
        tasks = held.leave("seen", n, merge_tasks(parts, key, measures, timeout), keep=1)
        over = F.col("ended") | (F.col("last") + F.expr(f"interval {timeout + delay} seconds") < F.lit(now))
        held.leave("tasks", n, tasks.where(over))
        held.leave("open", n, tasks.where(~over), keep=2)
        held.leave("clock", n, spark.createDataFrame([(now,)], "at timestamp"), keep=2)
    return action


def task_schema(schema, key: str, measures: list[str]) -> str:
    return f"{key} {schema[key].dataType.simpleString()}, first timestamp, last timestamp, ended boolean, events bigint, {', '.join(f'{m}_sum double' for m in measures)}"


def task_parts(batch: DataFrame, key: str, ts: str, ends, measures: list[str]) -> DataFrame:
    """Events of one key and time counted together: what goes through the ordered scan is bounded by the clock's resolution."""
    rows = batch.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumns({"_at": F.col(ts).cast("timestamp"), "_end": F.coalesce(ends, F.lit(False))})
    sums = [F.sum(F.col(m).cast("double")).alias(f"{m}_sum") for m in measures]
    return rows.groupBy(key, F.col("_at").alias("first"), F.col("_at").alias("last")).agg(F.bool_or("_end").alias("ended"), F.count(F.lit(1)).alias("events"), *sums)


def merge_tasks(parts: DataFrame, key: str, measures: list[str], timeout: int) -> DataFrame:
    """Parts (open tasks and new events) in the order of their times; a new task begins after an end or a gap beyond the timeout."""
    grouped = parts.groupBy(key, "first").agg(F.max("last").alias("last"), F.bool_or("ended").alias("ended"), F.sum("events").alias("events"), *[F.sum(f"{m}_sum").alias(f"{m}_sum") for m in measures])
    rows = grouped.withColumns({"_us": scan.micros(F.col("first")), "_end": scan.micros(F.col("last")), "_over": F.col("ended").cast("int")})
    rows = scan.chunked_scan(rows, [key], "_us", scan.time_chunk(F.col("_us")), _before=("prev", "_end"), _closed=("prev", "_over"))
    fresh = F.col("_before").isNull() | (F.col("_closed") == 1) | (F.col("_us") - F.col("_before") > timeout * 1_000_000)
    rows = scan.chunked_scan(rows.withColumn("_new", fresh.cast("bigint")), [key], "_us", scan.time_chunk(F.col("_us")), _task=("sum", "_new"))
    return rows.groupBy(key, "_task").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.bool_or("ended").alias("ended"), F.sum("events").alias("events"),
                                          *[F.sum(f"{m}_sum").alias(f"{m}_sum") for m in measures]).drop("_task")


def combined_tasks(spark: SparkSession, path: str, schema, key: str, measures: list[str], open_too: bool = True) -> DataFrame:
    """Tasks so far, with ``outcome`` ended, timed_out or (with ``open_too``) open."""
    held = Carried(spark, path)
    side = task_schema(schema, key, measures)
    outcome = F.when(F.col("ended"), F.lit("ended")).otherwise(F.lit("timed_out"))
    done = held.all("tasks", side).withColumn("outcome", outcome)
    return done.unionByName(held.newest("open", side).withColumn("outcome", F.lit("open"))) if open_too else done
