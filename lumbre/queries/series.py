"""Time series: gaps, forecasts, error, anomalies, explanations, segments."""

import datetime as dt

from pyspark.sql import functions as F

from lumbre.functions.dates import iso
from lumbre.operators import change, series as se
from lumbre.queries.registry import query

FMT = "'%Y-%m-%d %H:%M:%S'"
HOURLY = "h AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS step, count(*) AS n, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors FROM events GROUP BY 1)"
FILLED = (HOURLY + ", f AS (SELECT g.step, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors FROM "
          "(SELECT unnest(generate_series((SELECT min(step) FROM h), (SELECT max(step) FROM h))) AS step) g LEFT JOIN h USING (step))")


def _hourly(t):
    raw = se.bucketed(t.events, "ts", 60, {"n": F.count(F.lit(1)), "errors": F.count_if(F.col("event_type") == "error")})
    return se.materialized(se.fill_gaps(raw, 60, ["n", "errors"]))


@query("AN1 A9", "SELECT CAST(floor(epoch(ts) / 14400) AS BIGINT) AS step, count(*) AS event_volume, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS critical_events, round(sum(value), 2) AS measure_sum FROM events GROUP BY 1")
def series_features(t):
    f = se.role_features(t.events, critical=F.col("event_type") == "error", measure="value")
    return se.bucketed(t.events, "ts", 240, f).drop("bucket").withColumn("measure_sum", F.round("measure_sum", 2))


@query("AN1", f"WITH {FILLED} SELECT step, n, errors FROM f")
def gap_filled_hours(t):
    return _hourly(t).select("step", "n", "errors")


@query("AN2 AN3 A30", "SELECT CAST(CASE WHEN count(*) >= 6000 THEN 120 ELSE 480 END AS BIGINT) AS forecast_minutes, CAST(43 AS BIGINT) AS detection_minutes FROM events WHERE true")
def chosen_intervals(t):
    b = t.events.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    minutes = se.forecast_interval(b[0], b[1], b[2])
    return t.events.agg(F.max(F.lit(minutes)).cast("bigint").alias("forecast_minutes"), F.max(F.lit(se.detection_interval(b[0], b[1]))).cast("bigint").alias("detection_minutes"))


@query("W3 X10", f"WITH {FILLED} SELECT step, s FROM (SELECT step, array_to_string(list(n) OVER w, ',') AS s, count(*) OVER w AS k FROM f WINDOW w AS (ORDER BY step ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) WHERE k = 8")
def hourly_shingles(t):
    return se.shingles(_hourly(t), "n", 8).select("step", F.array_join(F.transform("shingle", lambda x: x.cast("string")), ",").alias("s"))


@query("W5", f"""WITH d AS (SELECT o_orderdate AS day, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT strftime(day, {FMT}) AS start, round(total, 2) AS total FROM (SELECT day, sum(v) OVER (ORDER BY day RANGE BETWEEN CURRENT ROW AND INTERVAL 364 DAY FOLLOWING) AS total FROM d) ORDER BY total DESC, day LIMIT 1""")
def best_365_day_window(t):
    daily = t.orders.groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("v"))
    return se.best_range(daily, "o_orderdate", "v").select(iso(F.col("start")).alias("start"), F.round("total", 2).alias("total"))


_NAIVE = f"""{FILLED}, e AS (SELECT max(step) AS last FROM f),
p AS (SELECT f.step + 24 * k AS target, avg(n) AS forecast FROM f, (VALUES (1), (2), (3), (4)) AS v(k) GROUP BY 1),
d AS (SELECT f.step AS origin, CAST(f.n - g.n AS DOUBLE) AS d FROM f LEFT JOIN f g ON g.step = f.step - 24),
q AS (SELECT origin, quantile_disc(d, 0.05) OVER w AS low, quantile_disc(d, 0.95) OVER w AS high FROM d WINDOW w AS (ORDER BY origin)),
b AS (SELECT step AS origin, h, step + h AS target FROM f, (SELECT unnest(generate_series(1, 8)) AS h)),
bounded AS (SELECT origin, h AS horizon_index, target, round(forecast, 6) AS forecast, round(forecast + low, 6) AS lower, round(forecast + high, 6) AS upper FROM b JOIN p USING (target) JOIN q USING (origin))
"""


def _rounded(forecasts):
    return forecasts.select("origin", F.col("horizon_index").cast("bigint").alias("horizon_index"), "target", *[F.round(c, 6).alias(c) for c in ("forecast", "lower", "upper")])


@query("AN4 AN6", f"WITH {_NAIVE} SELECT * FROM bounded")
def seasonal_backtest(t):
    return _rounded(se.seasonal_backtest(_hourly(t), "n", 24))


@query("AN4", f"WITH {_NAIVE} SELECT bounded.* FROM bounded, e WHERE origin = last")
def forecast_next_8(t):
    return _rounded(se.forecast(_hourly(t), "n", 24))


@query("AN9", f"WITH {FILLED} SELECT step, n FROM f WHERE step <= (SELECT max(step) FROM f) - 8")
def complete_origins(t):
    return se.complete_origins(_hourly(t)).select("step", "n")


def _at(c):
    return F.timestamp_seconds(F.col(c) * 3600)


@query("AN7 J7 W10", f"""WITH {_NAIVE}, o AS (SELECT DISTINCT b.origin FROM b JOIN p USING (target) ORDER BY 1 DESC LIMIT 50)
SELECT round(100 * sum(abs(forecast - n)) / sum(n), 1) AS wape_pct, count(*) AS steps FROM b JOIN o USING (origin) JOIN p USING (target) JOIN f ON f.step = b.target""")
def wape_last_50(t):
    hours = _hourly(t)
    fc = se.seasonal_backtest(hours, "n", 24).select(_at("origin").alias("origin_at"), _at("target").alias("target_at"), "forecast")
    actual = hours.select(_at("step").alias("target_at"), F.col("n").cast("double").alias("actual"))
    return se.wape(fc, actual, 3_600_000_000)


@query("AN8 W9", f"""WITH {_NAIVE}, a AS (SELECT max(step) AS anchor FROM (SELECT step, n, count(*) OVER w AS c, sum(CASE WHEN n <> 0 THEN 1 ELSE 0 END) OVER w AS z FROM f WINDOW w AS (ORDER BY step ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)) WHERE n <> 0 AND c = 8 AND z * 2 >= 8)
SELECT round(100 * avg(abs(forecast - n) / n), 1) AS mape_pct FROM b JOIN a ON b.origin = a.anchor JOIN p USING (target) JOIN f ON f.step = b.target WHERE n <> 0""")
def mape_at_anchor(t):
    hours = _hourly(t)
    anchor = se.choose_anchor(hours, "n").scalar()
    fc = se.seasonal_backtest(hours, "n", 24).where(F.col("origin") == anchor).select(_at("origin").alias("origin_at"), _at("target").alias("target_at"), "forecast")
    return se.mape(fc, hours.select(_at("step").alias("target_at"), F.col("n").cast("double").alias("actual")), 3_600_000_000)


@query("AN5 D6 AN14")
def anomaly_grade_hourly(t):
    return se.anomaly_listing(se.anomaly_grades(_hourly(t), ["errors", "n"], shingle=4), 50)


_W = change.Comparison.of(dt.datetime(2024, 1, 20), dt.datetime(2024, 1, 22))
_SHARES = """w AS (SELECT *, ts >= '2024-01-20' AS selected FROM events WHERE ts >= '2024-01-14' AND ts < '2024-01-22'),
c AS (SELECT field, value, count(*) FILTER (WHERE selected) AS s, count(*) FILTER (WHERE NOT selected) AS b FROM
(SELECT selected, 'event_type' AS field, event_type AS value FROM w UNION ALL SELECT selected, 'user_id', CAST(user_id AS VARCHAR) FROM w) GROUP BY 1, 2),
r AS (SELECT field, value, s / sum(s) OVER (PARTITION BY field) AS selection, b / sum(b) OVER (PARTITION BY field) AS base FROM c)"""


@query("AN10 AN11", f"""WITH {_SHARES}
SELECT field, value, round(selection, 6) AS selection, round(base, 6) AS base, round(divergence, 6) AS divergence FROM
(SELECT *, sum(abs(selection - base)) OVER (PARTITION BY field) / 2 AS divergence, row_number() OVER (PARTITION BY field ORDER BY abs(selection - base) DESC, value) AS k FROM r) WHERE k = 1 AND divergence > 0""")
def baseline_shift_by_type(t):
    shares = change.value_shares(change.label_windows(t.events, "ts", _W), ["event_type", "user_id"])
    return change.distribution_changes(shares).select("field", "value", *[F.round(c, 6).alias(c) for c in ("selection", "base", "divergence")])


@query("AN12 AN13", f"""WITH {_SHARES}, x AS (SELECT value, selection, base FROM r WHERE field = 'user_id' AND selection > base
ORDER BY CASE WHEN base = 0 THEN 0 ELSE 1 END, CASE WHEN base = 0 THEN selection ELSE selection / base END DESC, value LIMIT 6)
SELECT value AS valor, 'user_id' AS campo, CAST(round(100 * selection) AS BIGINT) AS pct_intervalo, CAST(round(100 * base) AS BIGINT) AS pct_antes FROM x""")
def rising_users(t):
    shares = change.value_shares(change.label_windows(t.events, "ts", _W), ["event_type", "user_id"])
    return change.change_table(change.pattern_changes(shares, "user_id"), "user_id")


@query("AN15 D6")
def kmeans_segments(t):
    return se.describe_clusters(se.kmeans(t.customer, ["c_acctbal", "c_nationkey"], 3), ["c_acctbal", "c_nationkey"])
