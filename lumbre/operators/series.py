"""Time series: interval choice, gap filling, forecasts, backtest error, anomalies, explanations.

A series is one row per interval, so its size depends on the range covered and
not on the number of events; ordered windows below run on such rows only.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumbre.functions.nested import let
from lumbre.operators.joins import nearest
from lumbre.session import cut_lineage

DAY_MINUTES = 1440
TARGET_STEPS = 600
DETECTION_STEPS = 1000
MIN_STEPS = 40
HORIZON = 8
ERROR_ORIGINS = 50
GRADE_ALERT = 0.7


# Widths of a step, in minutes, that divide a day.
STEP_MINUTES = (1, 2, 3, 4, 5, 6, 10, 12, 15, 20, 30, 60, 120, 180, 240, 360, 480, 720, 1440)


def forecast_interval(first: dt.datetime, last: dt.datetime, rows: int, steps: int = TARGET_STEPS, minimum: int = MIN_STEPS) -> int:
    """Minutes per step: a divisor or a multiple of a day, so that the daily cycle always falls on the same steps.

    About ``steps`` of them, fewer when that would leave less than ten rows in
    each, never less than ``minimum`` if a narrower step allows it.
    """
    span = max((last - first).total_seconds() / 60.0, 1.0)
    ideal = span / max(minimum, min(steps, rows // 10))
    if ideal <= DAY_MINUTES:
        interval = next(m for m in STEP_MINUTES if m >= ideal)
    else:
        interval = math.ceil(ideal / DAY_MINUTES) * DAY_MINUTES
    while span // interval < minimum and interval > 1:
        interval = interval - DAY_MINUTES if interval > DAY_MINUTES else max(m for m in STEP_MINUTES if m < interval)
    return interval


def detection_interval(first: dt.datetime, last: dt.datetime) -> int:
    """Minutes per detection step: a thousandth of the range, at least one."""
    return max(1, int((last - first).total_seconds() // 60 // DETECTION_STEPS))


def complete_origins(series: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Steps of the series whose whole horizon has data: an error can be measured for them."""
    return series.where(F.col("step") + horizon <= series.agg(F.max("step")).scalar())


def bucketed(df: DataFrame, ts: str, minutes: int, features: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """Every feature of every interval in one conditional-aggregate pass: (step, bucket, features)."""
    step = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / (minutes * 60)).cast("bigint")
    grouped = df.where(F.col(ts).isNotNull()).groupBy(*by, step.alias("step")).agg(*[c.alias(n) for n, c in features.items()])
    return grouped.withColumn("bucket", F.timestamp_seconds(F.col("step") * minutes * 60))


def role_features(df: DataFrame, critical: Column | None = None, entity: str | None = None, error: Column | None = None,
                  measure: str | None = None) -> dict[str, Column]:
    """Up to five features by role: volume, critical events, unique entities, errors, measure."""
    out = {"event_volume": F.count(F.lit(1))}
    if critical is not None:
        out["critical_events"] = F.count_if(critical)
    if entity:
        out["unique_entities"] = F.approx_count_distinct(entity)
    if error is not None:
        out["error_events"] = F.count_if(error)
    if measure:
        out["measure_sum"] = F.sum(measure)
    return out


def fill_gaps(series: DataFrame, minutes: int, values: list[str], by: list[str] = ()) -> DataFrame:
    """A row for every step between the first and the last of each series; missing values are 0."""
    bounds = series.groupBy(*by).agg(F.min("step").alias("a"), F.max("step").alias("b"))
    steps = bounds.where(F.col("a").isNotNull()).select(*by, F.explode(F.sequence("a", "b")).alias("step"))
    full = steps.join(series.select(*by, "step", *values), [*by, "step"], "left")
    return full.select(*by, "step", F.timestamp_seconds(F.col("step") * minutes * 60).alias("bucket"),
                       *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])


def materialized(series: DataFrame) -> DataFrame:
    """The series written out once (it has one row per interval), so that the steps after it do not read the events again."""
    return cut_lineage(series.coalesce(1), "series")


def moving_average(series: DataFrame, value: str, n: int = 7, by: list[str] = (), name: str = "trend") -> DataFrame:
    """Mean of the last ``n`` steps, NULL until there are that many."""
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(-(n - 1), 0)
    return series.withColumn(name, F.when(F.count(F.lit(1)).over(w) == n, F.avg(value).over(w)))


def growth(series: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Change against the previous step, in percent."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy("bucket"))
    return series.withColumn("previous", before).withColumn(
        "growth_pct", F.round(100.0 * (F.col(value) - before) / F.nullif(before, F.lit(0)), 2))


def shingles(series: DataFrame, value: str, size: int = 8, by: list[str] = ()) -> DataFrame:
    """Overlapping windows of ``size`` consecutive steps (rows before the first full one are left out)."""
    w = Window.partitionBy(*by).orderBy("step").rowsBetween(-(size - 1), 0)
    return series.withColumn("shingle", F.collect_list(value).over(w)).where(F.size("shingle") == size)


def best_range(series: DataFrame, day: str, value: str, days: int = 365) -> DataFrame:
    """One row: the start of the ``days``-day range with the largest total (ties: earliest)."""
    number = F.unix_date(F.col(day).cast("date"))
    w = Window.orderBy(number).rangeBetween(0, days - 1)
    totals = series.withColumn("total", F.sum(value).over(w))
    return totals.orderBy(F.desc("total"), F.asc(day)).limit(1).select(F.col(day).alias("start"), "total")


def seasonal_backtest(series: DataFrame, value: str, season: int, horizon: int = HORIZON, band: float = 0.9,
                      history: int = 4) -> DataFrame:
    """Every origin forecasts its next ``horizon`` steps with the mean of the same step of the last ``history`` seasons.

    The band comes from quantiles of the one-season differences that are known
    at the origin (NULL where there are none yet). Only steps fully inside the past of the origin are used: the
    season must not be shorter than the horizon.
    """
    if season < horizon:
        raise ValueError("the season must cover the horizon")
    s = series.select("step", F.col(value).cast("double").alias("y"))
    past = s.select(F.explode(F.array(*[F.struct((F.col("step") + season * k).alias("target"), F.col("y").alias("y"))
                                        for k in range(1, history + 1)])).alias("p")).select("p.*")
    predicted = past.groupBy("target").agg(F.avg("y").alias("forecast"))
    lagged = s.join(s.select((F.col("step") + season).alias("step"), F.col("y").alias("y0")), "step")
    known = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    quantile = lambda q: F.percentile_approx(F.col("y") - F.col("y0"), q, 10_000).over(known)
    bands = s.select("step").join(lagged, "step", "left").select(F.col("step").alias("origin"), quantile((1 - band) / 2).alias("low"), quantile((1 + band) / 2).alias("high"))
    edge = s.agg(F.max("step")).scalar()
    origins = s.select(F.col("step").alias("origin"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")) \
        .withColumn("target", F.col("origin") + F.col("h"))
    return origins.join(predicted, "target").join(bands, "origin").where(F.col("target") <= edge + horizon).select(
        "origin", F.col("h").alias("horizon_index"), "target", "forecast",
        (F.col("forecast") + F.col("low")).alias("lower"), (F.col("forecast") + F.col("high")).alias("upper"))


def forecast(series: DataFrame, value: str, season: int, horizon: int = HORIZON, **kw) -> DataFrame:
    """The forecast from the last step of the series."""
    last = series.agg(F.max("step")).scalar()
    return seasonal_backtest(series, value, season, horizon, **kw).where(F.col("origin") == last)


def _with_actual(forecasts: DataFrame, actuals: DataFrame, step_us: int) -> DataFrame:
    """Forecast rows with the real value nearest to their target, half a step away at most."""
    return nearest(forecasts, actuals, [], "target_at", "actual", step_us // 2)


def wape(forecasts: DataFrame, actuals: DataFrame, step_us: int, origins: int = ERROR_ORIGINS) -> DataFrame:
    """One row: weighted error in percent over the latest origins; NULL if the real values add up to 0.

    ``forecasts``: origin_at, target_at, forecast. ``actuals``: target_at, actual.
    """
    w = Window.orderBy(F.desc("origin_at"))
    latest = forecasts.select("origin_at").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= origins).select("origin_at")
    kept = forecasts.join(latest, "origin_at", "left_semi")
    matched = _with_actual(kept, actuals, step_us).where(F.col("nearest_actual").isNotNull())
    error, reference = F.sum(F.abs(F.col("forecast") - F.col("nearest_actual"))), F.sum(F.abs("nearest_actual"))
    return matched.agg(F.round(100 * error / F.nullif(reference, F.lit(0.0)), 1).alias("wape_pct"), F.count(F.lit(1)).alias("steps"))


def mape(forecasts: DataFrame, actuals: DataFrame, step_us: int) -> DataFrame:
    """One row: mean percentage error over the steps whose real value is not 0."""
    matched = _with_actual(forecasts, actuals, step_us).where(F.col("nearest_actual") != 0)
    return matched.agg(F.round(100 * F.avg(F.abs(F.col("forecast") - F.col("nearest_actual")) / F.abs("nearest_actual")), 1).alias("mape_pct"))


def choose_anchor(series: DataFrame, value: str, horizon: int = HORIZON) -> DataFrame:
    """One row: the last non-zero step whose next ``horizon`` steps exist and are at least half non-zero."""
    ahead = Window.orderBy("step").rowsBetween(1, horizon)
    nonzero = (F.col(value) != 0).cast("int")
    scored = series.withColumns({"_n": F.count(F.lit(1)).over(ahead), "_z": F.sum(nonzero).over(ahead)})
    ok = (F.col(value) != 0) & (F.col("_n") == horizon) & (F.col("_z") * 2 >= horizon)
    return scored.agg(F.max(F.when(ok, F.col("step"))).alias("anchor"))


def anomaly_grades(series: DataFrame, values: list[str], history: int = 48, shingle: int = 8, minimum: int = 8, by: list[str] = ()) -> DataFrame:
    """Grade 0–1 per step: how far the mean of a short window lies from the recent past, in robust deviations.

    For each feature the window mean of ``shingle`` steps is compared with the
    median and the median absolute deviation of the window means before it;
    features are averaged, as one series. 3 deviations grade 0, 10 grade 1.
    """
    order = Window.partitionBy(*by).orderBy("step")
    recent, past = order.rowsBetween(-(shingle - 1), 0), order.rowsBetween(-history, -1)
    df = series.withColumns({f"_m_{v}": F.avg(F.col(v).cast("double")).over(recent) for v in values})
    df = df.withColumns({f"_p_{v}": F.collect_list(f"_m_{v}").over(past) for v in values})
    scores = []
    for v in values:
        hist, now = F.col(f"_p_{v}"), F.col(f"_m_{v}")
        robust = let(_median(hist), lambda centre: F.struct(
            centre.alias("c"), _median(F.transform(hist, lambda x: F.abs(x - centre))).alias("s")))
        scores.append(F.when(F.size(hist) >= minimum, let(robust, lambda r: F.abs(now - r["c"]) / F.greatest(
            1.4826 * r["s"], 0.05 * F.abs(r["c"]), F.lit(1e-9)))).otherwise(F.lit(0.0)))
    z = sum(scores[1:], scores[0]) / F.lit(float(len(scores)))
    grade = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (z - 3) / 7))
    return df.select(*by, "step", "bucket", *values, F.round(grade, 4).alias("grade"))


def _median(values: Column) -> Column:
    """Middle of a short array."""
    def middle(s: Column) -> Column:
        n = F.size(s)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return let(F.array_sort(values), middle)


def anomaly_listing(grades: DataFrame, n: int = 20, minimum: float = 0.0) -> DataFrame:
    return grades.where(F.col("grade") > minimum).orderBy(F.desc("grade"), F.asc("step")).limit(n)


def kmeans(df: DataFrame, columns: list[str], k: int = 3, seed: int = 7) -> DataFrame:
    """Rows with their ``cluster`` on two or three numeric columns (rows missing one are left out)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    vectors = VectorAssembler(inputCols=columns, outputCol="_raw").transform(rows)
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(vectors).transform(vectors)
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(scaled)
    return model.transform(scaled).drop("_raw", "_x")


def describe_clusters(clustered: DataFrame, columns: list[str]) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("total"), *[F.avg(c).alias(f"avg_{c}") for c in columns])
