"""Derived tables: entity profile, hourly rollup, distinct texts, templates and funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumbre.functions.nested import let
from lumbre.operators.aggregates import time_bucket


def critical_count(df: DataFrame, field: str) -> Column:
    """Critical events by the indicator's type: booleans count true, numbers add up, texts count when present."""
    kind = df.schema[field].dataType.typeName()
    if kind == "boolean":
        return F.count_if(F.col(field))
    if kind in ("integer", "long", "double", "float", "short", "byte"):
        return F.coalesce(F.sum(field), F.lit(0))
    return F.count(field)


def entity_measure(agg: str, field: str) -> Column:
    """Averages skip rows without the value; an entity with none of them gets 0, never NULL."""
    return F.coalesce({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[agg](field), F.lit(0))


def entity_profile(df: DataFrame, entity: str, ts: str, measures: list[tuple[str, str]] = (), critical: str | None = None) -> DataFrame:
    """One row per entity: events, critical events, measures and the last event. All partial aggregates."""
    aggs = [F.count(ts).alias("events")]
    if critical:
        aggs.append(critical_count(df, critical).alias("critical"))
    aggs += [entity_measure(agg, field).alias(f"{agg}_{field}") for field, agg in measures]
    aggs.append(F.max(ts).alias("last"))
    return df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(*aggs)


def profile_order(profile: DataFrame, by: str, n: int = 15) -> DataFrame:
    return profile.orderBy(F.desc(by), F.asc("entity")).limit(n)


def hourly_rollup(df: DataFrame, ts: str, dimensions: list[str], measures: list[str], count_only: tuple[str, ...] = (),
                  interval: str = "hour") -> DataFrame:
    """Per hour and dimensions: sum, average, min, max and count of each measure (ids and codes are only counted)."""
    aggs = [F.count(F.lit(1)).alias("events")]
    for m in measures:
        if m not in count_only:
            aggs += [F.sum(m).alias(f"{m}_sum"), F.avg(m).alias(f"{m}_avg"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
        aggs.append(F.count(m).alias(f"{m}_count"))
    return df.groupBy(time_bucket(F.col(ts), interval).alias("hour"), *dimensions).agg(*aggs)


def requery_rollup(rollup: DataFrame, interval: str, dimensions: list[str], measures: list[str]) -> DataFrame:
    """The rollup summed up again; an average is the sum of sums over the sum of counts."""
    aggs = [F.sum("events").alias("events")]
    for m in measures:
        aggs += [F.sum(f"{m}_sum").alias(f"{m}_sum"), F.min(f"{m}_min").alias(f"{m}_min"), F.max(f"{m}_max").alias(f"{m}_max"),
                 (F.sum(f"{m}_sum") / F.sum(f"{m}_count")).alias(f"{m}_avg"), F.sum(f"{m}_count").alias(f"{m}_count")]
    return rollup.groupBy(time_bucket(F.col("hour"), interval).alias("bucket"), *dimensions).agg(*aggs)


def answer_from(rollup: DataFrame, raw: DataFrame, dimensions: list[str], measures: list[str]) -> DataFrame:
    """The rollup when it holds what is asked, else the raw rows."""
    needed = {*dimensions, *[f"{m}_sum" for m in measures]}
    return rollup if needed <= set(rollup.columns) else raw


def distinct_texts(df: DataFrame, text: str) -> DataFrame:
    """Each different text with how many times it occurs: what is indexed for search."""
    return df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("count"))


# Fixed values, in order: variable tokens of a log message and what stands for them.
_VARIABLES = (
    (r"\b[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?", "<date>"),
    (r"\b(?:https?|ftp)://\S+", "<url>"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "<email>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "<ip>"),
    (r"\b0x[0-9a-fA-F]+\b", "<hex>"),
    (r"\b\d+(?:[.,]\d+)*\b", "<num>"),
)


def template(c: Column) -> Column:
    """The text with its variable tokens masked."""
    for rx, mark in _VARIABLES:
        c = F.regexp_replace(c, rx, mark)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def text_templates(df: DataFrame, text: str) -> DataFrame:
    """Log templates by count, with a sample of each. Masking happens before the shuffle."""
    present = df.where(F.col(text).isNotNull())
    return present.groupBy(template(F.col(text)).alias("template")).agg(
        F.count(F.lit(1)).alias("count"), F.min(text).alias("sample"))


def merged_templates(templates: DataFrame, max_variants: int = 8) -> DataFrame:
    """Second pass over templates of equal length and first word: a position with many different words becomes ``<*>``."""
    words = F.split("template", " ")
    placed = templates.select("template", "count", F.size(words).alias("length"), F.get(words, 0).alias("head"),
                              F.posexplode(words).alias("position", "word"))
    variety = placed.groupBy("length", "head", "position").agg(F.approx_count_distinct("word").alias("variants"))
    merged = placed.join(variety, ["length", "head", "position"]) \
        .withColumn("word", F.when((F.col("variants") > max_variants) & (F.col("position") > 0), F.lit("<*>")).otherwise(F.col("word")))
    # One list per template, as long as the template itself.
    rebuilt = merged.groupBy("template", "count").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "word"))), lambda s: s["word"]), " ").alias("merged"))
    return rebuilt.groupBy(F.col("merged").alias("template")).agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("variants"))


def funnel(steps: Column) -> Column:
    """Summary of the ordered steps of one event (array of struct code, index, status, timedout, lateResp)."""
    def ranked(given: Column) -> Column:
        # native comparison of index and place, so that equal indexes keep their order
        return F.sort_array(F.transform(given, lambda s, i: F.struct(
            F.coalesce(s["index"].try_cast("int"), F.lit(0)).alias("at"), i.alias("place"), *[s[c].alias(c) for c in ("code", "index", "status", "timedout", "lateResp")])))

    def summary(ordered: Column, ok: Column) -> Column:
        bad = F.filter(ordered, lambda s: ~s["status"].eqNullSafe(F.lit("C")))
        last = F.try_element_at(ordered, F.lit(-1))
        timeout = F.exists(ordered, lambda s: s["timedout"].eqNullSafe(F.lit("True")))
        return F.struct(
            F.size(ordered).alias("steps_total"), F.size(ok).alias("steps_completed"),
            F.transform(ordered, lambda s: s["code"]).alias("steps_reached"), F.transform(ok, lambda s: s["code"]).alias("steps_ok"),
            last["code"].alias("last_step_code"), last["index"].try_cast("int").alias("last_step_index"),
            last["status"].alias("last_step_status"), F.try_element_at(ok, F.lit(-1))["code"].alias("deepest_ok_code"),
            ((F.size(ok) < F.size(ordered)) | timeout).alias("failed"), F.get(bad, 0)["code"].alias("failed_at_code"),
            timeout.alias("had_timeout"), F.exists(ordered, lambda s: s["lateResp"].eqNullSafe(F.lit("True"))).alias("had_late_resp"))

    # sorted and filtered once for all fields
    return F.when(F.size(steps) > 0, let(ranked(steps), lambda ordered: let(F.filter(ordered, lambda s: s["status"] == "C"), lambda ok: summary(ordered, ok))))


def funnel_from_rows(df: DataFrame, key: str, index: str, code: str, ok: Column) -> DataFrame:
    """The same summary when each step is a row: only mergeable aggregates, so a key of any size is fine."""
    at = F.struct(F.col(index), F.col(code))
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("steps_total"), F.count_if(ok).alias("steps_completed"),
        F.max(at)[code].alias("last_step_code"), F.max(F.when(ok, at))[code].alias("deepest_ok_code"),
        F.min(F.when(~ok, at))[code].alias("failed_at_code"), (F.count_if(ok) < F.count(F.lit(1))).alias("failed"))


def funnel_reach(df: DataFrame, key: str, code: str) -> DataFrame:
    """How many keys reached each step (once per key)."""
    return df.select(key, code).distinct().groupBy(code).agg(F.count(F.lit(1)).alias("reached"))


def slim_items(items: Column, keep: int = 4, leaves: dict[str, str] | None = None) -> Column:
    """First items of an array of structs, with the chosen leaves (new name → name) only."""
    kept = F.slice(items, 1, keep)
    return F.transform(kept, lambda x: F.struct(*[x[old].alias(new) for new, old in leaves.items()])) if leaves else kept


def slim_document(df: DataFrame, leaves: dict[str, str], items: dict[str, tuple[str, dict[str, str]]], keep: int = 4) -> DataFrame:
    """A document reduced to some leaves (new name → path) and the first items of its arrays (new name → path, leaves of an item).

    A null array counts as empty.
    """
    arrays = [F.coalesce(slim_items(F.col(path), keep, inner), slim_items(F.slice(F.array(F.get(F.col(path), F.lit(0))), 2, 1), keep, inner)).alias(name) for name, (path, inner) in items.items()]
    return df.select(*[F.col(path).alias(name) for name, path in leaves.items()], *arrays)


def with_failure(df: DataFrame, column: str, ok: list | None = None, fails: list | None = None) -> DataFrame:
    """``<column>_falla``: the value where it is a failure, else NULL.

    A failure is a value of the list ``fails``, or any present value outside the list ``ok``; exactly one of them is given.
    """
    if (ok is None) == (fails is None):
        raise ValueError("give either the values that are fine or those that are failures")
    c = F.col(column)
    bad = c.isin(*fails) if fails is not None else ~c.isin(*ok)
    return df.withColumn(f"{column.rpartition('.')[2]}_falla", F.when(c.isNotNull() & bad, c))


def query_log_summary(log: DataFrame, by: str, n: int = 15) -> DataFrame:
    """Heaviest queries on data by latency, CPU or memory; queries on internal tables only are out."""
    on_data = (F.size("indices") > 0) & F.exists("indices", lambda i: ~i.startswith("."))
    number = lambda m: F.coalesce(F.col(f"measurements.{m}.number"), F.lit(0.0))
    top = log.where(on_data).orderBy(F.desc(number(by)), F.asc("timestamp")).limit(n)
    return top.select(
        F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("hora"), F.array_join("indices", ", ").alias("indices"),
        F.round(number("latency")).cast("bigint").alias("latencia_ms"), F.round(number("cpu") / 1e6, 1).alias("cpu_ms"),
        F.round(number("memory") / 1024, 1).alias("memoria_kb"), query_shape(F.col("source")).alias("forma"), F.col("total_shards").alias("shards"))


def query_shape(source: Column) -> Column:
    """What a logged query does, from its JSON text."""
    aggs = F.coalesce(F.get_json_object(source, "$.aggregations"), F.get_json_object(source, "$.aggs"))
    by_name = F.from_json(aggs, "map<string,map<string,string>>")
    kinds = F.array_distinct(F.flatten(F.transform(F.map_values(by_name), lambda m: F.filter(
        F.map_keys(m), lambda k: ~k.isin("aggregations", "aggs", "meta")))))
    named = F.slice(F.array_sort(kinds), 1, 3)
    size = F.get_json_object(source, "$.size").try_cast("int")
    query = F.get_json_object(source, "$.query")
    return F.when(F.size(F.map_keys(by_name)) > 0, F.concat(F.lit("agregación"), F.when(
        F.size(named) > 0, F.concat(F.lit(" ("), F.array_join(named, ", "), F.lit(")"))).otherwise(F.lit("")))) \
        .when(query.isNotNull() & (query != "{}"), F.when(F.coalesce(size, F.lit(10)) > 0, F.lit("búsqueda con filtro")).otherwise(F.lit("conteo con filtro"))) \
        .otherwise(F.when(size == 0, F.lit("conteo total")).otherwise(F.lit("búsqueda")))
