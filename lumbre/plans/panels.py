"""A board panel as a DataFrame: one small description in, (panel, key, split, value) rows out.

Description keys: ``type`` (metric, table, bar, pie, tagcloud, area, line, heatmap,
map, region_map, filters, search), ``title``, ``metric`` (count, sum, avg, min, max,
cardinality), ``agg_field``, ``field``, ``split``, ``size``, ``query`` (a condition),
``filters`` (name → condition).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumbre.functions.dates import iso
from lumbre.operators import aggregates as ag
from lumbre.plans.roles import INFORMATIVE_LEVELS

COLUMN_ROLES = ("entity_id", "primary_dimension", "critical_indicator", "success_indicator", "measure", "dimension")


def _rows(df: DataFrame, title: str, key: Column, value: Column, split: Column | None = None) -> DataFrame:
    return df.select(F.lit(title).alias("panel"), key.cast("string").alias("key"),
                     (split if split is not None else F.lit("")).cast("string").alias("split"),
                     F.round(F.coalesce(value, F.lit(0)).cast("double"), 4).alias("value"))


def _metric(spec: dict, exact: bool) -> Column:
    return ag.metric(spec.get("metric", "count"), spec.get("agg_field") or spec.get("field"), exact=exact)


def panel(df: DataFrame, spec: dict, ts: str, interval: str = "day", exact: bool = True) -> DataFrame:
    kind, title, field = spec["type"], spec["title"], spec.get("field")
    if spec.get("query") is not None:
        df = df.where(spec["query"])
    agg = _metric(spec, exact)
    if kind == "metric":
        return _rows(df.agg(agg.alias("v")), title, F.lit(""), F.col("v"))
    if kind in ("table", "bar", "pie", "tagcloud", "region_map"):
        size = spec.get("size") or {"tagcloud": 15, "region_map": 100}.get(kind, 10)
        return _rows(ag.top_terms(df, field, size, agg, "v"), title, F.col(field), F.col("v"))
    if kind in ("area", "line", "heatmap"):
        split = spec.get("split") or (field if kind == "heatmap" else None)
        if split:
            out = ag.series_by(df, ts, interval, split, spec.get("size") or (12 if kind == "heatmap" else 5), agg, "v")
            return _rows(out, title, iso(F.col("bucket")), F.col("v"), F.col(split))
        return _rows(ag.date_histogram(df, ts, interval, {"v": agg}), title, iso(F.col("bucket")), F.col("v"))
    if kind == "map":
        return _rows(ag.geohash_grid(df, spec["lat"], spec["lon"], spec.get("precision", 3)), title, F.col("cell"), F.col("value"))
    if kind == "filters":
        return _rows(ag.named_filters(df, spec["filters"]), title, F.col("filter"), F.col("value"))
    raise ValueError(f"unknown panel type {kind}")


def board(df: DataFrame, specs: list[dict], ts: str, interval: str = "day", exact: bool = True) -> DataFrame:
    """All panels of a board. Metrics over plain counts and sums share one pass; the others keep their own grouping."""
    plain = [s for s in specs if s["type"] == "metric"]
    parts = []
    if plain:
        one = df.agg(*[_conditional(s, exact).alias(f"m{i}") for i, s in enumerate(plain)])
        rows = F.array(*[F.struct(F.lit(s["title"]).alias("panel"), F.col(f"m{i}").cast("double").alias("v")) for i, s in enumerate(plain)])
        parts.append(_rows_of_metrics(one.select(F.explode(rows).alias("r")).select("r.*")))
    parts += [panel(df, s, ts, interval, exact) for s in specs if s["type"] != "metric"]
    return reduce(DataFrame.unionByName, parts)


def _rows_of_metrics(df: DataFrame) -> DataFrame:
    return df.select("panel", F.lit("").alias("key"), F.lit("").alias("split"), F.round(F.coalesce("v", F.lit(0.0)), 4).alias("value"))


def _conditional(spec: dict, exact: bool) -> Column:
    """The metric restricted by its own query, so that several fit in one aggregate."""
    q = spec.get("query")
    name, field = spec.get("metric", "count"), spec.get("agg_field") or spec.get("field")
    if q is None:
        return _metric(spec, exact)
    if name == "count":
        return F.count_if(q)
    value = F.when(q, F.col(field))
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "value_count": F.count,
            "cardinality": F.count_distinct if exact else F.approx_count_distinct}[name](value)


def critical_condition(df: DataFrame, field: str) -> Column:
    """Critical events by the type of their indicator: true, a number above 0, or any text."""
    kind = df.schema[field].dataType.typeName()
    if kind == "boolean":
        return F.col(field)
    return F.col(field) > 0 if kind in ("integer", "long", "double", "float") else F.col(field).isNotNull()


def level_problem(level: str) -> Column:
    """A level is there and is not an informative one."""
    return F.col(level).isNotNull() & ~F.col(level).isin(*INFORMATIVE_LEVELS)


def problem_levels(level: str, rx: str) -> Column:
    return F.col(level).rlike(rx)


def critical_from_forecast(kind: str, field: str, values: list | None = None) -> Column:
    """Critical condition implied by a failure forecast: a summed indicator is 1 or more, a counted one is present, a filter is its terms."""
    if kind == "filter":
        return F.col(field).isin(*values)
    return F.col(field) >= 1 if kind == "sum" else F.col(field).isNotNull()


def controls(df: DataFrame, fields: list[str], size: int = 10) -> DataFrame:
    """Options of each filter control: the leading values of each field, from one scan."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("option")) for f in fields])
    counted = df.select(F.explode(cells).alias("c")).select("c.*").where(F.col("option").isNotNull()).groupBy("field", "option") \
        .agg(F.count(F.lit(1)).alias("n"))
    return ag.top_per_group(counted, ["field"], [F.desc("n"), F.asc("option")], size)


def apply_controls(df: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """Several choices in one control mean any of them; controls combine with and."""
    for f, values in chosen.items():
        if values:
            df = df.where(F.col(f).isin(*values))
    return df


def listing_columns(profile: DataFrame, volume: str | None = None, n: int = 6) -> list[str]:
    """Names of at most ``n`` columns for a listing, out of a profile table (``position``, ``path``, ``type``, ``role``).

    Dates are left out. Columns stand in the order of their roles; the volume column is third, or earlier by its role.
    """
    role = F.coalesce(F.nullif(F.array_position(F.lit(list(COLUMN_ROLES)), F.col("role")), F.lit(0)), F.lit(len(COLUMN_ROLES) + 1))
    place = F.row_number().over(Window.orderBy(role, "position"))
    shown = profile.where((F.col("path") != "@timestamp") & F.coalesce(F.col("type") != "date", F.lit(True))).select("path", place.alias("place"))
    third = F.when(F.col("path") == F.lit(volume), F.least("place", F.lit(2.5))).otherwise(F.col("place"))
    return [r["path"] for r in shown.orderBy(third).limit(n).collect()]


def saved_search(df: DataFrame, ts: str, columns: list[str], tie: str, size: int = 500, query: Column | None = None) -> DataFrame:
    """Newest rows first, chosen columns only."""
    rows = df.where(query) if query is not None else df
    return rows.select(ts, tie, *[c for c in columns if c not in (ts, tie)]).orderBy(F.desc(ts), F.asc(tie)).limit(size)


def automatic_boards(parts: dict, columns: dict[str, str]) -> dict[str, list[dict]]:
    """Summary, problems and times boards from the classification of a table (one row of ``roles.classify`` as a dict).

    ``columns`` maps each column to its type. A board appears only if the columns it needs are there.
    """
    main, entity, level = parts.get("main_dimension"), parts.get("entity"), parts.get("level")
    amount, duration, critical = parts.get("amount"), parts.get("duration"), parts.get("critical")
    boards: dict[str, list[dict]] = {"summary": [{"type": "metric", "title": "events"}]}
    s = boards["summary"]
    if entity:
        s.append({"type": "metric", "title": f"unique {entity}", "metric": "cardinality", "agg_field": entity})
    if amount:
        s.append({"type": "metric", "title": f"sum {amount}", "metric": "sum", "agg_field": amount})
    if parts.get("has_time"):
        s.append({"type": "area", "title": "events over time", **({"split": main} if main else {})})
    if main:
        s.append({"type": "pie", "title": f"by {main}", "field": main})
        if amount:
            s.append({"type": "table", "title": f"top {main} by {amount}", "field": main, "metric": "sum", "agg_field": amount})
    if entity:
        s.append({"type": "table", "title": f"top {entity}", "field": entity})
    problem = None
    if critical:
        kind = columns.get(critical)
        problem = F.col(critical) if kind == "boolean" else F.col(critical) > 0 if kind in ("integer", "float") else F.col(critical).isNotNull()
    elif level:
        problem = level_problem(level)
    if problem is not None:
        boards["problems"] = [{"type": "metric", "title": "problems", "query": problem}]
        p = boards["problems"]
        if parts.get("has_time"):
            p.append({"type": "area", "title": "problems over time", "query": problem})
        for f in filter(None, (main, entity, parts.get("component"))):
            p.append({"type": "table", "title": f"problems by {f}", "field": f, "query": problem})
    if duration:
        boards["times"] = [{"type": "metric", "title": f"average {duration}", "metric": "avg", "agg_field": duration},
                           {"type": "metric", "title": f"slowest {duration}", "metric": "max", "agg_field": duration}]
        if parts.get("has_time"):
            boards["times"].append({"type": "line", "title": f"{duration} over time", "metric": "avg", "agg_field": duration})
        if main:
            boards["times"].append({"type": "table", "title": f"{duration} by {main}", "field": main, "metric": "avg", "agg_field": duration})
    return boards
