"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumbre.operators import derived, security, series
from lumbre.sources import sinks
from lumbre.sources.folders import file_system
from lumbre.sources.keyed import KeyedTable

ONCE = {"availableNow": True}


def event_stream(spark: SparkSession, folder: str, name: str, schema, ts: str = "ts", max_files: int | None = None) -> DataFrame:
    """A Parquet table as a stream; its time becomes a zoned timestamp, which watermarks require."""
    return table_stream(spark, folder, name, schema, max_files).withColumn(ts, F.col(ts).cast("timestamp"))


def table_stream(spark: SparkSession, folder: str, name: str, schema, max_files: int | None = None) -> DataFrame:
    """The Parquet table ``name`` of a folder as a stream, be it one file or a folder of files.

    The pattern is in the path, where it finds both; a plain path to a file is refused, and a file filter does not look into folders.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parquet*")


def run_once(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet") -> DataFrame:
    """Everything available now into a table, then the table."""
    q = df.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", f"{path}__checkpoint") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)


def run_once_latest(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Everything available now, windows that are still open included: the newest state of each key.

    Each micro-batch writes the rows it changed into a folder of its own, so a batch that is run again replaces its own rows;
    a later run goes on from the checkpoint and adds newer states of the windows left open.
    """
    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    for_each_batch(df, save, f"{path}__checkpoint", "update").awaitTermination()
    rows = df.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, batch long").parquet(path)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "batch").alias("_row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def for_each_batch(df: DataFrame, action, checkpoint: str, mode: str = "append", trigger: dict | None = None):
    return df.writeStream.foreachBatch(action).outputMode(mode).option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or ONCE)).start()


def dedup(df: DataFrame, id_column: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Each id once, as long as copies arrive within the watermark. State is bounded by the delay."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_column])


def hourly_rollup(df: DataFrame, ts: str, dimensions: list[str], measures: list[str], delay: str = "10 minutes",
                  interval: str = "1 hour") -> DataFrame:
    """Tumbling rollup; an hour is emitted once, when the watermark passes it."""
    aggs = [F.count(F.lit(1)).alias("events")]
    for m in measures:
        aggs += [F.sum(m).alias(f"{m}_sum"), F.avg(m).alias(f"{m}_avg"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"),
                 F.count(m).alias(f"{m}_count")]
    grouped = df.withWatermark(ts, delay).groupBy(F.window(ts, interval).alias("w"), *dimensions).agg(*aggs)
    return grouped.select(F.col("w.start").alias("hour"), *dimensions, *[c for c in grouped.columns if c not in ("w", *dimensions)])


def windowed_counts(df: DataFrame, ts: str, interval: str, delay: str, features: dict[str, Column]) -> DataFrame:
    """Detection intervals: closed only after ``delay``, so late events within it still count."""
    grouped = df.withWatermark(ts, delay).groupBy(F.window(ts, interval).alias("w")).agg(*[c.alias(n) for n, c in features.items()])
    return grouped.select(F.col("w.start").alias("bucket"), *features)


def sliding_sums(df: DataFrame, ts: str, step: str, width: str, delay: str, features: dict[str, Column]) -> DataFrame:
    """Overlapping windows ``width`` long, one every ``step``."""
    grouped = df.withWatermark(ts, delay).groupBy(F.window(ts, width, step).alias("w")).agg(*[c.alias(n) for n, c in features.items()])
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *features)


def profile_merger(path: str, entity: str, ts: str, measures: list[str]):
    """``foreachBatch`` action: per-entity partial sums of the batch, merged into the stored profile.

    What is stored are sums and counts, so batches merge exactly; averages are
    taken on reading. Memory does not grow with the number of entities because
    the profile is a table, not stream state; a batch rewrites the buckets of
    its own entities. The batch id makes a replayed batch harmless.
    """
    def partial(batch: DataFrame) -> DataFrame:
        aggs = [F.count(ts).alias("events"), F.max(ts).alias("last")]
        for m in measures:
            aggs += [F.sum(m).alias(f"{m}_sum"), F.count(m).alias(f"{m}_count"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
        return batch.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(*aggs)

    return _merge_action(path, partial, "entity", {
        "events": F.sum, "last": F.max, **{f"{m}_sum": F.sum for m in measures}, **{f"{m}_count": F.sum for m in measures},
        **{f"{m}_min": F.min for m in measures}, **{f"{m}_max": F.max for m in measures}})


def read_profile(spark: SparkSession, path: str, measures: list[str]) -> DataFrame:
    """The stored profile with averages; an entity without a measure has 0."""
    df = sinks.current_table(spark, path)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = [F.col("entity"), F.col("events"), F.col("last")]
    for m in measures:
        out += [zero(F.col(f"{m}_sum")).alias(f"sum_{m}"), zero(F.col(f"{m}_sum") / F.nullif(F.col(f"{m}_count"), F.lit(0))).alias(f"avg_{m}"),
                zero(F.col(f"{m}_min")).alias(f"min_{m}"), zero(F.col(f"{m}_max")).alias(f"max_{m}")]
    return df.select(*out)


def text_merger(path: str, text: str):
    """``foreachBatch`` action: distinct texts of the batch added to the stored counts."""
    return _merge_action(path, lambda b: derived.distinct_texts(b, text), "text", {"count": F.sum})


def _merge_action(path: str, partial, key: str, merge: dict):
    def action(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(batch.sparkSession, path, key, merge).update(partial(batch), batch_id)
    return action


def rule_findings(df: DataFrame, rules: list[security.Rule]) -> DataFrame:
    """Stateless: every new row against every rule."""
    return security.findings(df, rules)


def high_grades(grades: DataFrame, ts: str = "bucket", interval: str = "10 minutes", delay: str = "10 minutes",
                threshold: float = series.GRADE_ALERT) -> DataFrame:
    """One row per monitoring interval with at least one anomaly at the threshold or above."""
    hit = grades.where(F.col("grade") >= threshold).withWatermark(ts, delay)
    grouped = hit.groupBy(F.window(ts, interval).alias("w")).agg(F.count(F.lit(1)).alias("hits"), F.max("grade").alias("max_grade"))
    return grouped.select(F.col("w.start").alias("checked_at"), "hits", "max_grade")


def throttled_alerts(alerts: DataFrame, monitor: str, at: str, minutes: int = 60) -> DataFrame:
    """Batch: the alerts of each monitor that are sent, at most one in any ``minutes``.

    Distinct firing times are sorted by Spark and read once in order, so a task holds one time a monitor however long its history.
    """
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType
    span = minutes * 60
    times = alerts.select(F.col(monitor), F.unix_seconds(F.col(at).cast("timestamp")).alias("_t")).where(F.col(monitor).isNotNull() & F.col("_t").isNotNull()).distinct()

    def run(batches):
        who, last = None, None
        for batch in batches:
            keep = []
            for i, (m, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if m != who or last is None or t - last >= span:
                    who, last = m, t
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    schema = StructType([alerts.schema[monitor], StructField("_t", LongType())])
    sent = times.repartition(monitor).sortWithinPartitions(monitor, "_t").mapInArrow(run, schema)
    return sent.select(monitor, F.timestamp_seconds("_t").alias(at))


def throttled_alert_stream(alerts: DataFrame, monitor: str, at: str, minutes: int = 60, delay: str = "10 minutes") -> DataFrame:
    """The same on a stream.  The state of a monitor is the time of its last alert; it leaves when the watermark (``delay`` behind the
    newest time) passes the end of the span in which that alert holds others back."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    import pandas as pd
    span = minutes * 60

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted({int(x) for f in frames for x in f["_t"].unique()}):
            if last is None or t - last >= span:
                last = t
                out.append(t)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + span) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({monitor: [key[0]] * len(out), "_t": pd.Series(out, dtype="int64")})

    kind = alerts.schema[monitor].dataType.simpleString()
    seconds = alerts.withWatermark(at, delay).select(F.col(monitor), F.col(at), F.unix_seconds(F.col(at)).alias("_t"))
    sent = seconds.groupBy(monitor).applyInPandasWithState(step, f"{monitor} {kind}, _t bigint", "last bigint", "append",
                                                           GroupStateTimeout.EventTimeTimeout)
    return sent.select(monitor, F.timestamp_seconds("_t").alias(at))


# Retention ------------------------------------------------------------------
WARM_DAYS, MONTH_DAYS = 35, 31
DEFAULT_RETENTION, MIN_RETENTION, MAX_RETENTION = 90, 7, 3650


def retention_plan(months: DataFrame, today: dt.date, asked=None) -> DataFrame:
    """What to do with each monthly partition (``month`` = yyyy_MM): keep hot, compact (warm) or drop.

    ``asked`` is the retention in days as somebody typed it, or a column of such texts: a positive whole number counts, within
    bounds, anything else means the default. A month goes when all of its days are past the retention and it has been warm.
    """
    typed = (asked if isinstance(asked, Column) else F.lit(None if asked is None else str(asked))).try_cast("int")
    kept = F.when(typed > 0, F.least(F.greatest(typed, F.lit(MIN_RETENTION)), F.lit(MAX_RETENTION))).otherwise(F.lit(DEFAULT_RETENTION))
    rows = months.withColumns({"age_days": F.datediff(F.lit(today), F.to_date("month", "yyyy_MM")), "drop_after": F.greatest(kept + MONTH_DAYS, F.lit(WARM_DAYS + 1))})
    action = F.when(F.col("age_days") >= F.col("drop_after"), "drop").when(F.col("age_days") >= WARM_DAYS, "warm").otherwise("hot")
    return rows.select("month", "age_days", action.alias("action"))


def apply_retention(spark: SparkSession, path: str, today: dt.date, asked=None, files_per_month: int = 1) -> list[tuple[str, str]]:
    """Drop old monthly partitions and rewrite warm ones into fewer files. Returns what was done, one pair per partition."""
    fs, root = file_system(spark, path)
    names = [s.getPath().getName()[len("month="):] for s in fs.listStatus(root)
             if s.isDirectory() and s.getPath().getName().startswith("month=")]
    if not names:
        return []
    plan = retention_plan(spark.createDataFrame([(n,) for n in names], "month string"), today, asked).collect()
    jvm = spark.sparkContext._jvm
    done = []
    for row in sorted(plan, key=lambda r: r["month"]):
        part = jvm.org.apache.hadoop.fs.Path(root, f"month={row['month']}")
        if row["action"] == "drop":
            fs.delete(part, True)
            done.append((row["month"], "drop"))
        elif row["action"] == "warm":
            files = [s.getPath().getName() for s in fs.listStatus(part) if s.getPath().getName().endswith(".parquet")]
            if len(files) <= files_per_month:
                continue
            # Written aside and swapped in by rename, so a failed rewrite leaves the partition as it was.
            aside = jvm.org.apache.hadoop.fs.Path(root, f"_compact_{row['month']}")
            fs.delete(aside, True)
            spark.read.parquet(part.toString()).repartition(files_per_month).write.parquet(aside.toString())
            old = jvm.org.apache.hadoop.fs.Path(root, f"_old_{row['month']}")
            fs.rename(part, old)
            fs.rename(aside, part)
            fs.delete(old, True)
            done.append((row["month"], "warm"))
    return done
