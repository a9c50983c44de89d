"""Metrics, top-N, histograms and the aggregations built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumbre.functions import net

PERCENTILES = (1, 5, 25, 50, 75, 95, 99)
PANEL_PERCENTILES = (50, 95, 99)


def metric(agg: str, field: str | None = None, percents: tuple[int, ...] = PERCENTILES, exact: bool = False) -> Column:
    """The aggregate a panel names. ``cardinality`` and ``percentiles`` are sketches unless ``exact``."""
    if agg == "count":
        return F.count(F.lit(1))
    if agg == "value_count":
        return F.count(field)
    if agg == "cardinality":
        return F.count_distinct(field) if exact else F.approx_count_distinct(field)
    if agg == "percentiles":
        shares = F.array(*[F.lit(p / 100.0) for p in percents])
        return F.percentile_approx(field, shares, 10_000)
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[agg](field)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def top_terms(df: DataFrame, field: str, size: int = 10, agg: Column | None = None, name: str = "value",
              ascending: bool = False) -> DataFrame:
    """Top values by a metric: rows without the field are out, ties by key, no "other" row."""
    grouped = df.where(F.col(field).isNotNull()).groupBy(field).agg((agg if agg is not None else F.count(F.lit(1))).alias(name))
    return grouped.orderBy(F.asc(name) if ascending else F.desc(name), F.asc(field)).limit(size)


def top_terms_by_percentile(df: DataFrame, field: str, measure: str, percent: int = 99, size: int = 10, name: str = "value") -> DataFrame:
    """Terms ordered by the highest percentile the panel looks at."""
    return top_terms(df, field, size, F.percentile_approx(measure, percent / 100.0, 10_000), name)


def array_terms(df: DataFrame, field: str, size: int = 10, name: str = "value") -> DataFrame:
    """Top values of an array field: a row counts once per distinct element."""
    exploded = df.select(F.explode(F.array_distinct(field)).alias(field))
    return top_terms(exploded, field, size, name=name)


def date_histogram(df: DataFrame, ts: str, interval: str, aggs: dict[str, Column], by: list[str] = (), bucket: str = "bucket") -> DataFrame:
    """Aggregates per fixed UTC interval; empty intervals give no row."""
    return df.where(F.col(ts).isNotNull()).groupBy(time_bucket(F.col(ts), interval).alias(bucket), *by) \
        .agg(*[c.alias(n) for n, c in aggs.items()])


#: widths that an automatic histogram may take, in seconds: 1 second to a year
WIDTHS = (1, 5, 10, 30, 60, 300, 600, 1800, 3600, 10_800, 43_200, 86_400, 604_800, 2_592_000, 31_536_000)


def auto_date_histogram(df: DataFrame, ts: str, aggs: dict[str, Column], most: int = 100, by: list[str] = (), bucket: str = "bucket") -> DataFrame:
    """The same with the smallest of ``WIDTHS`` that gives ``most`` buckets at most over the rows' range (the largest, if none does).

    The width is worked out inside the plan from one aggregate of the same rows.
    """
    rows = df.where(F.col(ts).isNotNull()).withColumn("_s", F.unix_seconds(F.col(ts).cast("timestamp")))
    lo, hi = F.min("_s"), F.max("_s")
    fits = lambda w: F.floor(hi / w) - F.floor(lo / w) < most
    chosen = F.when(fits(WIDTHS[0]), F.lit(WIDTHS[0]))
    for w in WIDTHS[1:-1]:
        chosen = chosen.when(fits(w), F.lit(w))
    width = rows.agg(chosen.otherwise(F.lit(WIDTHS[-1])).cast("bigint").alias("w")).scalar()
    placed = rows.withColumn("_w", width).withColumn(bucket, F.timestamp_seconds(F.floor(F.col("_s") / F.col("_w")) * F.col("_w")))
    return placed.groupBy(bucket, *by).agg(*[c.alias(n) for n, c in aggs.items()])


def quantile_rollup(df: DataFrame, ts: str, interval: str, by: list[str], measure: str, k: int = 800) -> DataFrame:
    """Rollup rows that keep a mergeable quantile sketch of the measure (rank error below 1 per cent at ``k`` = 800)."""
    return date_histogram(df, ts, interval, {"events": F.count(F.lit(1)), "sketch": F.kll_sketch_agg_double(F.col(measure).cast("double"), k)}, by)


def merged_quantiles(rollup: DataFrame, interval: str, by: list[str], percents: tuple[int, ...] = PANEL_PERCENTILES) -> DataFrame:
    """A coarser rollup and its percentiles out of the stored sketches, without the rows."""
    grouped = rollup.groupBy(time_bucket(F.col("bucket"), interval).alias("period"), *by).agg(F.sum("events").alias("events"), F.kll_merge_agg_double("sketch").alias("_s"))
    return grouped.select("period", *by, "events", *[F.kll_sketch_get_quantile_double("_s", F.lit(p / 100.0)).alias(f"p{p}") for p in percents])


def time_bucket(ts: Column, interval: str) -> Column:
    """``hour``, ``day``, ``month`` … or a width such as ``15 minutes``."""
    if " " in interval:
        return F.window(ts, interval)["start"]
    return F.date_trunc(interval, ts)


def top_values(df: DataFrame, field: str, size: int, agg: Column | None = None) -> DataFrame:
    """The leading values alone, ``size`` rows at most."""
    return top_terms(df, field, size, agg, "_rank_value").select(field)


def keep_top(df: DataFrame, field: str, size: int, agg: Column | None = None) -> DataFrame:
    """Rows whose value is among the leading ones of the whole range. The list is limited, so it is broadcast."""
    return df.join(F.broadcast(top_values(df, field, size, agg)), field, "left_semi")


def series_by(df: DataFrame, ts: str, interval: str, split: str, size: int = 5, agg: Column | None = None, name: str = "value",
              bucket: str = "bucket") -> DataFrame:
    """Time series split by the leading values, chosen over the whole range and only then bucketed."""
    agg = agg if agg is not None else F.count(F.lit(1))
    return date_histogram(keep_top(df, split, size, agg), ts, interval, {name: agg}, [split], bucket)


def heat_map(df: DataFrame, ts: str, interval: str, field: str, size: int = 12, name: str = "value") -> DataFrame:
    return series_by(df, ts, interval, field, size, name=name)


def named_filters(df: DataFrame, filters: dict[str, Column], by: list[Column] = ()) -> DataFrame:
    """Count per named filter (a row may be in several), all in one pass: (…, filter, value)."""
    counted = df.groupBy(*by).agg(*[F.count_if(c).alias(f"_f{i}") for i, c in enumerate(filters.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("filter"), F.col(f"_f{i}").alias("value")) for i, n in enumerate(filters)])
    kept = [c for c in counted.columns if not c.startswith("_f")]
    return counted.select(*kept, F.explode(rows).alias("_r")).select(*kept, "_r.filter", "_r.value").where(F.col("value") > 0)


def metric_table(df: DataFrame, field: str, aggs: dict[str, Column], size: int = 10, sub: str | None = None, sub_size: int = 3) -> DataFrame:
    """Several metrics per leading value, ordered by the first; with ``sub``, its leading values inside each."""
    first = next(iter(aggs))
    if sub is None:
        out = df.where(F.col(field).isNotNull()).groupBy(field).agg(*[c.alias(n) for n, c in aggs.items()])
        return out.orderBy(F.desc(first), F.asc(field)).limit(size)
    kept = keep_top(df, field, size, aggs[first]).where(F.col(sub).isNotNull())
    grouped = kept.groupBy(field, sub).agg(*[c.alias(n) for n, c in aggs.items()])
    return top_per_group(grouped, [field], [F.desc(first), F.asc(sub)], sub_size)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group. The planner limits every group map-side before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def geohash_grid(df: DataFrame, lat: str, lon: str, precision: int = 3) -> DataFrame:
    """Rows per geohash cell with the centroid of what is in it."""
    point = net.geo_point(F.col(lat), F.col(lon))
    located = df.withColumn("_p", point).where(F.col("_p").isNotNull())
    return located.groupBy(net.geohash(F.col("_p.lat"), F.col("_p.lon"), precision).alias("cell")) \
        .agg(F.count(F.lit(1)).alias("value"), F.avg("_p.lat").alias("lat"), F.avg("_p.lon").alias("lon"))


def region_map(df: DataFrame, country: str, layer: DataFrame, layer_name: str, size: int = 100) -> DataFrame:
    """Leading countries joined by name to a map layer; a name the layer does not know stays without shape."""
    top = top_terms(df, country, size)
    return top.join(layer, top[country] == layer[layer_name], "left")


def failure_breakdown(df: DataFrame, field: str, failed: Column) -> DataFrame:
    """Failures, total and failure rate per value."""
    return df.where(F.col(field).isNotNull()).groupBy(field) \
        .agg(F.count_if(failed).alias("failed"), F.count(F.lit(1)).alias("total")) \
        .withColumn("failed_pct", F.round(100.0 * F.col("failed") / F.col("total"), 2))


def share_of_total(grouped: DataFrame, value: str, total: str = "grand_total", pct: str = "pct") -> DataFrame:
    """Each group next to the total of all of them. The total is one scalar, not a window over every row."""
    whole = grouped.agg(F.sum(value)).scalar()
    return grouped.withColumn(total, whole).withColumn(pct, F.round(F.col(value) * 100.0 / F.col(total), 2))


def rate_total(df: DataFrame, entity: str, ts: str, rate: str, interval: str = "day") -> DataFrame:
    """Total of a rate per interval: averaged per entity first, then summed across entities."""
    per_entity = df.where(F.col(rate).isNotNull()).groupBy(time_bucket(F.col(ts), interval).alias("bucket"), entity) \
        .agg(F.avg(rate).alias("_avg"))
    return per_entity.groupBy("bucket").agg(F.sum("_avg").alias("total"))


def most_frequent(df: DataFrame, field: str) -> DataFrame:
    return top_terms(df, field, 1)


def bounds(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("rows"))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """Exact interpolated percentiles per group, whatever the size of a group.

    Equal values are counted first. A logarithmic histogram per group (a few
    thousand cells at most) tells which cells hold the wanted ranks, and only
    those cells are ordered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    size = F.floor(F.log2(F.abs("v")) * 64) + 100_000
    counts = counts.withColumn("cell", F.when(F.col("v") == 0, 0).when(F.col("v") > 0, size).otherwise(-size).cast("bigint"))
    cells = counts.groupBy(*keys, "cell").agg(F.sum("n").alias("m"))
    run = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("upto", F.sum("m").over(run)) \
        .withColumn("total", F.sum("m").over(Window.partitionBy(*keys)))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("percent")
    cells = cells.select(*keys, "cell", (F.col("upto") - F.col("m")).alias("below"), "upto", "total", wanted)
    rank = (F.col("total") - 1) * F.col("percent") / 100.0
    low, high = F.floor(rank), F.ceil(rank)
    # Ranks are zero-based: a cell holds ranks [below, upto).
    holds = (low < F.col("upto")) & (high >= F.col("below"))
    targets = cells.where(holds).select(*keys, "cell", "below", "percent", rank.alias("rank"), low.alias("low"), high.alias("high"))
    within = Window.partitionBy(*keys, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    needed = counts.join(targets.select(*keys, "cell").distinct(), [*keys, "cell"], "left_semi") \
        .withColumn("seen", F.sum("n").over(within))
    hits = needed.join(targets, [*keys, "cell"])
    first, last = F.col("below") + F.col("seen") - F.col("n"), F.col("below") + F.col("seen") - 1
    return hits.groupBy(*keys, "percent").agg(
        F.max(F.when(F.col("low").between(first, last), F.col("v"))).alias("_lo"),
        F.max(F.when(F.col("high").between(first, last), F.col("v"))).alias("_hi"), F.max("rank").alias("_r")) \
        .select(*keys, "percent", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_r") - F.floor("_r"))).alias("value"))


def throttle(df: DataFrame, keys: list[str], ts: str, period: str, limit: int, tie: str) -> DataFrame:
    """First ``limit`` rows of each key in each period."""
    bucket = time_bucket(F.col(ts), period)
    kept = top_per_group(df.withColumn("period", bucket), [*keys, "period"], [F.asc(ts), F.asc(tie)], limit)
    return kept.drop("rank")


def combine_task(df: DataFrame, task: str, ts: str, amount: str) -> DataFrame:
    """Rows of a task as one: how many, from when to when, and the amounts added up."""
    return df.where(F.col(task).isNotNull()).groupBy(task).agg(
        F.count(F.lit(1)).alias("steps"), F.min(ts).alias("started"), F.max(ts).alias("ended"), F.sum(amount).alias("amount"))


def moving_rates(df: DataFrame, ts: str, minutes: tuple[int, ...] = (1, 5, 15)) -> DataFrame:
    """Events per minute averaged over the last 1, 5 and 15 minutes. Windows run over minute totals only."""
    per_minute = date_histogram(df, ts, "minute", {"events": F.count(F.lit(1))})
    order = Window.orderBy(F.unix_seconds(F.col("bucket").cast("timestamp")))
    return per_minute.withColumns({f"rate_{m}m": F.sum("events").over(order.rangeBetween(-(m - 1) * 60, 0)) / F.lit(float(m))
                                   for m in minutes})
