"""Metrics, top-N, histograms, shares and windows."""

from pyspark.sql import functions as F

from lumbre.functions import net
from lumbre.functions.dates import iso
from lumbre.operators import aggregates as ag, series
from lumbre.plans import keyvalue
from lumbre.queries.registry import query
from lumbre.session import scratch_path

FMT = "'%Y-%m-%d %H:%M:%S'"


@query("P5 T2 R2 F1 A7 J11 A9 A10", f"""
WITH errors AS (SELECT * FROM events WHERE event_type = 'error'),
top AS (SELECT user_id FROM errors GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 5)
SELECT strftime(date_trunc('day', ts), {FMT}) AS day, user_id, count(*) AS n
FROM errors WHERE user_id IN (SELECT user_id FROM top) GROUP BY 1, 2""")
def top5_error_users_daily(t):
    e = t.spread("events", "ts", "user_id", "event_type")
    lines = e.select(F.concat_ws(" ", F.concat(F.lit("ts="), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
                                 F.concat(F.lit("user_id="), F.col("user_id").cast("string")),
                                 F.concat(F.lit("event_type="), F.col("event_type"))).alias("value"))
    parsed = keyvalue.parse_lines(lines)
    get = lambda k: F.try_element_at("pairs", F.lit(k))
    typed = parsed.select(get("ts").try_cast("timestamp").alias("ts"), get("user_id").try_cast("bigint").alias("user_id"),
                          get("event_type").alias("event_type"))
    out = ag.series_by(typed.where(F.col("event_type") == "error"), "ts", "day", "user_id", 5, name="n", bucket="day")
    return out.select(iso(F.col("day")).alias("day"), "user_id", "n")


@query("A1 A9", f"SELECT strftime(date_trunc('hour', ts), {FMT}) AS hour, count(*) AS n FROM events GROUP BY 1")
def events_per_hour(t):
    return ag.date_histogram(t.events, "ts", "hour", {"n": ag.metric("count")}, bucket="hour").withColumn("hour", iso(F.col("hour")))


@query("A9", f"""SELECT strftime(time_bucket(INTERVAL 15 minutes, ts), {FMT}) AS bucket, count(*) AS n, round(sum(value), 2) AS value
FROM events GROUP BY 1""")
def events_per_quarter_hour(t):
    out = ag.date_histogram(t.events, "ts", "15 minutes", {"n": ag.metric("count"), "value": F.round(F.sum("value"), 2)})
    return out.withColumn("bucket", iso(F.col("bucket")))


@query("A17 A18", f"""SELECT strftime(date_trunc('day', ts), {FMT}) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total
FROM events GROUP BY 1, 2""")
def events_per_day_by_type(t):
    out = ag.date_histogram(t.events, "ts", "day", {"n": ag.metric("count"), "total": F.round(F.sum("value"), 2)}, ["event_type"], "day")
    return out.withColumn("day", iso(F.col("day")))


@query("A1 A2 A3 A4", """SELECT count(*) AS n, count(value) AS n_value, round(sum(value), 2) AS total, round(avg(value), 4) AS mean,
min(value) AS lowest, max(value) AS highest, count(DISTINCT user_id) AS users FROM events""")
def metric_summary(t):
    return t.events.agg(ag.metric("count").alias("n"), ag.metric("value_count", "value").alias("n_value"),
                        F.round(ag.metric("sum", "value"), 2).alias("total"), F.round(ag.metric("avg", "value"), 4).alias("mean"),
                        ag.metric("min", "value").alias("lowest"), ag.metric("max", "value").alias("highest"),
                        ag.metric("cardinality", "user_id", exact=True).alias("users"))


@query("A4 A31", f"""SELECT strftime(date_trunc('day', ts), {FMT}) AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def unique_users_daily(t):
    return ag.date_histogram(t.events, "ts", "day", {"users": ag.metric("cardinality", "user_id", exact=True)}, bucket="day") \
        .withColumn("day", iso(F.col("day")))


@query("A5", " UNION ALL ".join(f"SELECT event_type, CAST({p} AS DOUBLE) AS percent, round(quantile_cont(value, {p / 100.0}), 6) AS value "
                                f"FROM events GROUP BY 1" for p in ag.PERCENTILES))
def value_percentiles_by_type(t):
    return ag.exact_percentiles(t.events, ["event_type"], "value").withColumn("value", F.round("value", 6))


@query("A5", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95,
round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1""")
def price_percentiles_panel(t):
    long = ag.exact_percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", ag.PANEL_PERCENTILES)
    return long.groupBy("l_returnflag").agg(*[F.round(F.max(F.when(F.col("percent") == p, F.col("value"))), 4).alias(f"p{p}")
                                              for p in ag.PANEL_PERCENTILES])


@query("A6", """SELECT CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors,
CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS big, CAST(count(*) FILTER (WHERE event_type = 'purchase' AND value > 10) AS BIGINT) AS sales
FROM events""")
def filtered_counts(t):
    c = F.col
    return t.events.agg(ag.count_where(c("event_type") == "error").alias("errors"), ag.count_where(c("value") > 50).alias("big"),
                        ag.count_where((c("event_type") == "purchase") & (c("value") > 10)).alias("sales"))


@query("A7", """SELECT user_id, round(sum(value), 2) AS total FROM events GROUP BY 1 ORDER BY sum(value) DESC, user_id LIMIT 10""")
def top_users_by_value(t):
    return ag.top_terms(t.events, "user_id", 10, F.sum("value"), "total").withColumn("total", F.round("total", 2))


@query("A27", """SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n, event_type LIMIT 3""")
def rare_event_types(t):
    return ag.top_terms(t.events, "event_type", 3, name="n", ascending=True)


@query("A8 A5", """SELECT user_id, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1 ORDER BY quantile_cont(value, 0.99) DESC, user_id LIMIT 10""")
def users_by_p99_value(t):
    p = ag.exact_percentiles(t.events, ["user_id"], "value", (99,))
    return p.orderBy(F.desc("value"), "user_id").limit(10).select("user_id", F.round("value", 6).alias("p99"))


@query("A8")
def users_by_p95_sketch(t):
    return ag.top_terms_by_percentile(t.events, "user_id", "value", 95, 10)


@query("A10 J11", f"""WITH top AS (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 5)
SELECT strftime(date_trunc('day', ts), {FMT}) AS day, user_id, count(*) AS n FROM events
WHERE user_id IN (SELECT user_id FROM top) GROUP BY 1, 2""")
def top5_users_daily_series(t):
    out = ag.series_by(t.events, "ts", "day", "user_id", 5, name="n", bucket="day")
    return out.select(iso(F.col("day")).alias("day"), "user_id", "n")


@query("A11", f"""SELECT day, filter, value FROM (
SELECT strftime(date_trunc('day', ts), {FMT}) AS day, unnest(['errors', 'high value', 'purchases']) AS filter,
unnest([count(*) FILTER (WHERE event_type = 'error'), count(*) FILTER (WHERE value > 80), count(*) FILTER (WHERE event_type = 'purchase')]) AS value
FROM events GROUP BY date_trunc('day', ts)) WHERE value > 0""")
def named_filter_series(t):
    out = ag.named_filters(t.events, {"errors": F.col("event_type") == "error", "high value": F.col("value") > 80,
                                      "purchases": F.col("event_type") == "purchase"}, [F.date_trunc("day", "ts").alias("day")])
    return out.withColumn("day", iso(F.col("day")))


@query("A12 W4", """WITH top AS (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 10),
g AS (SELECT user_id, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE user_id IN (SELECT user_id FROM top) GROUP BY 1, 2)
SELECT user_id, event_type, n, mean FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) <= 3""")
def users_with_leading_types(t):
    out = ag.metric_table(t.events, "user_id", {"n": F.count(F.lit(1)), "mean": F.avg("value")}, 10, "event_type", 3)
    return out.select("user_id", "event_type", "n", F.round("mean", 4).alias("mean"))


@query("A12", """SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, max(value) AS highest
FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 10""")
def metric_table_by_type(t):
    return ag.metric_table(t.events, "event_type", {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 2),
                                                    "mean": F.round(F.avg("value"), 4), "highest": F.max("value")})


@query("A13", f"""WITH top AS (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 12)
SELECT strftime(date_trunc('day', ts), {FMT}) AS day, user_id, count(*) AS n FROM events
WHERE user_id IN (SELECT user_id FROM top) GROUP BY 1, 2""")
def user_heat_map(t):
    out = ag.heat_map(t.events, "ts", "day", "user_id", 12, "n")
    return out.select(iso(F.col("bucket")).alias("day"), "user_id", "n")


@query("A14", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def pie_order_priority(t):
    return ag.top_terms(t.orders, "o_orderpriority", 10, name="n")


@query("A14", """SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1 ORDER BY n DESC, word LIMIT 15""")
def tag_cloud_part_words(t):
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("word"))
    return ag.top_terms(words, "word", 15, name="n")


@query("A29", """SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_name || ' ' || p_type, ' '))) AS word FROM part)
GROUP BY 1 ORDER BY n DESC, word LIMIT 10""")
def array_terms_part_words(t):
    return ag.array_terms(t.part.select(F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("word")), "word", 10, "n")


# Coordinates made of the keys; the oracle interleaves the same fixed-width integers.
_LAT = "(CAST((c_custkey * 37) % 1800 AS DOUBLE) / 10.0 - 90.0)"
_LON = "(CAST((c_custkey * 91) % 3600 AS DOUBLE) / 10.0 - 180.0)"
_X = f"least(CAST(floor(({_LON} + 180.0) / 360.0 * 256.0) AS BIGINT), 255)"
_Y = f"least(CAST(floor(({_LAT} + 90.0) / 180.0 * 128.0) AS BIGINT), 127)"


def _geohash_sql() -> str:
    chars = []
    for char in range(3):
        bits = []
        for b in range(5):
            i = char * 5 + b
            src, pos = ("x", 7 - i // 2) if i % 2 == 0 else ("y", 6 - i // 2)
            bits.append(f"(({src} >> {pos}) & 1) * {2 ** (4 - b)}")
        chars.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({' + '.join(bits)} + 1 AS BIGINT), 1)")
    return " || ".join(chars)


@query("A15 R12", f"""SELECT cell, count(*) AS n, round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon FROM (
SELECT {_geohash_sql()} AS cell, lat, lon FROM (SELECT {_X} AS x, {_Y} AS y, {_LAT} AS lat, {_LON} AS lon FROM customer)
WHERE NOT (lat = 0 AND lon = 0)) GROUP BY 1""")
def geohash_grid_customers(t):
    located = t.customer.select((((F.col("c_custkey") * 37) % 1800).cast("double") / 10.0 - 90.0).alias("lat"),
                                (((F.col("c_custkey") * 91) % 3600).cast("double") / 10.0 - 180.0).alias("lon"))
    out = ag.geohash_grid(located, "lat", "lon", 3)
    return out.select("cell", F.col("value").alias("n"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query("A16 J9", """WITH top AS (SELECT n_name AS country, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, 1 LIMIT 100)
SELECT country, n, r_name AS shape FROM top LEFT JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') l
ON l.n_name = top.country""")
def region_map_customers(t):
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("country"))
    layer = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where(F.col("r_name") != "ASIA").select("n_name", "r_name")
    return ag.region_map(named, "country", layer, "n_name").select("country", F.col("value").alias("n"), F.col("r_name").alias("shape"))


@query("A7 A3", """SELECT p_brand, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1 ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, 1 LIMIT 5""")
def top5_revenue_brands(t):
    # Summed per part first: the join then moves one row per part and not one per line.
    per_part = t.lineitem.groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    brands = per_part.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return ag.top_terms(brands, "p_brand", 5, F.sum("r"), "revenue").withColumn("revenue", F.round("revenue", 2))


@query("A19 N1 R15", f"""SELECT strftime(date_trunc('day', ts), {FMT}) AS day, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
count(*) AS total, round(100.0 * sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*), 2) AS failed_pct FROM events GROUP BY 1""")
def error_rate_by_day(t):
    days = t.events.withColumn("day", F.date_trunc("day", "ts"))
    return ag.failure_breakdown(days, "day", F.col("event_type") == "error").withColumn("day", iso(F.col("day")))


@query("A20", f"""SELECT strftime(day, {FMT}) AS day, round(sum(m), 4) AS total FROM
(SELECT date_trunc('day', l_shipdate) AS day, l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def rate_avg_then_sum(t):
    out = ag.rate_total(t.lineitem, "l_suppkey", "l_shipdate", "l_quantity")
    return out.select(iso(F.col("bucket")).alias("day"), F.round("total", 4).alias("total"))


@query("A30", f"SELECT strftime(min(ts), {FMT}) AS first_at, strftime(max(ts), {FMT}) AS last_at, count(*) AS rows FROM events")
def time_bounds(t):
    return ag.bounds(t.events, "ts").select(iso(F.col("first_at")).alias("first_at"), iso(F.col("last_at")).alias("last_at"), "rows")


@query("A32", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def most_frequent_segment(t):
    return ag.most_frequent(t.customer, "c_mktsegment").withColumnRenamed("value", "n")


@query("A35", "SELECT DISTINCT user_id, event_type FROM events")
def distinct_user_types(t):
    return t.events.select("user_id", "event_type").dropDuplicates()


@query("W1", """SELECT event_type, n, CAST(sum(n) OVER () AS BIGINT) AS grand_total, round(n * 100.0 / sum(n) OVER (), 2) AS pct
FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def share_of_total_by_type(t):
    return ag.share_of_total(t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "n")


@query("W2", f"""SELECT strftime(day, {FMT}) AS day, n, CASE WHEN count(*) OVER w = 7 THEN round(avg(n) OVER w, 4) END AS trend
FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1) WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def sma7_daily(t):
    daily = ag.date_histogram(t.events, "ts", "day", {"n": F.count(F.lit(1))})
    return series.moving_average(daily, "n").select(iso(F.col("bucket")).alias("day"), "n", F.round("trend", 4).alias("trend"))


@query("W2 N1", f"""SELECT strftime(day, {FMT}) AS day, n, round(100.0 * (n - p) / p, 2) AS growth_pct
FROM (SELECT day, n, lag(n) OVER (ORDER BY day) AS p FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1)) WHERE p IS NOT NULL""")
def growth_daily(t):
    daily = ag.date_histogram(t.events, "ts", "day", {"n": F.count(F.lit(1))})
    return series.growth(daily, "n").where(F.col("previous").isNotNull()).select(iso(F.col("bucket")).alias("day"), "n", "growth_pct")


@query("W4", """SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) <= 3""")
def top3_types_per_user(t):
    g = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return ag.top_per_group(g, ["user_id"], [F.desc("n"), F.asc("event_type")], 3).drop("rank")


@query("O1 O2 O3", f"""SELECT o_orderkey, strftime(o_orderdate, {FMT}) AS at, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def newest_orders(t):
    return t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", iso(F.col("o_orderdate")).alias("at"), "o_totalprice")


@query("O4 R14", "SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def highest_value_events(t):
    return t.events.select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id").limit(20)


@query("O5", """SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1, 2
ORDER BY n DESC, avg(p_retailprice), p_brand, p_type LIMIT 25""")
def part_ranking_ties(t):
    g = t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("price"))
    return g.orderBy(F.desc("n"), "price", "p_brand", "p_type").limit(25).withColumn("price", F.round("price", 4))


@query("E14", f"""WITH m AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS events FROM events GROUP BY 1)
SELECT strftime(minute, {FMT}) AS minute, events, round(sum(events) OVER (ORDER BY minute RANGE BETWEEN INTERVAL 0 MINUTE PRECEDING AND CURRENT ROW) / 1.0, 4) AS rate_1m,
round(sum(events) OVER (ORDER BY minute RANGE BETWEEN INTERVAL 4 MINUTE PRECEDING AND CURRENT ROW) / 5.0, 4) AS rate_5m,
round(sum(events) OVER (ORDER BY minute RANGE BETWEEN INTERVAL 14 MINUTE PRECEDING AND CURRENT ROW) / 15.0, 4) AS rate_15m FROM m""")
def moving_event_rates(t):
    out = ag.moving_rates(t.events, "ts")
    return out.select(iso(F.col("bucket")).alias("minute"), "events", *[F.round(f"rate_{m}m", 4).alias(f"rate_{m}m") for m in (1, 5, 15)])


@query("E13", f"""SELECT event_id, user_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2""")
def throttled_events(t):
    return ag.throttle(t.events, ["user_id"], "ts", "day", 2, "event_id").select("event_id", "user_id")


_FITS = " ".join(f"WHEN floor(hi / {w}) - floor(lo / {w}) < 60 THEN {w}" for w in ag.WIDTHS[:-1])


@query("A9 A17", f"""WITH r AS (SELECT floor(min(epoch(ts))) AS lo, floor(max(epoch(ts))) AS hi FROM events), w AS (SELECT CASE {_FITS} ELSE {ag.WIDTHS[-1]} END AS w FROM r)
SELECT strftime(make_timestamp(CAST(floor(floor(epoch(ts)) / w) * w * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, w GROUP BY 1, 2""")
def automatic_histogram(t):
    out = ag.auto_date_histogram(t.events, "ts", {"n": F.count(F.lit(1)), "total": F.sum("value")}, 60, ["event_type"])
    return out.select(iso(F.col("bucket")).alias("bucket"), "event_type", "n", F.round("total", 2).alias("total"))


# percentiles of a day out of hourly sketches: their true rank, by all rows of the day, is within two per cent
@query("A24 A23 A5 E14", """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, true AS p50, true AS p95, true AS p99 FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def rollup_percentiles_daily(t):
    path = scratch_path(t.spark, "sketches")
    rows = t.events.where("value IS NOT NULL")
    ag.quantile_rollup(rows, "ts", "hour", ["event_type"], "value").write.parquet(path)
    days = ag.merged_quantiles(t.spark.read.parquet(path), "day", ["event_type"])
    q = days.select(F.date_format("period", "yyyy-MM-dd").alias("day"), "event_type", "events", *[F.col(f"p{p}").alias(f"q{p}") for p in (50, 95, 99)])
    told = rows.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).join(q, ["day", "event_type"])
    one = F.lit(1.0)
    fits = lambda p: ((F.count_if(F.col("value") < F.col(f"q{p}")) - one) / F.count(F.lit(1)) <= p / 100 + 0.02) & ((F.count_if(F.col("value") <= F.col(f"q{p}")) + one) / F.count(F.lit(1)) >= p / 100 - 0.02)
    return told.groupBy("day", "event_type", "events").agg(*[fits(p).alias(f"p{p}") for p in (50, 95, 99)])


@query("E11", f"""SELECT l_orderkey, count(*) AS steps, strftime(min(l_shipdate), {FMT}) AS started, strftime(max(l_shipdate), {FMT}) AS ended,
round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1""")
def combined_order_lines(t):
    out = ag.combine_task(t.lineitem, "l_orderkey", "l_shipdate", "l_extendedprice")
    return out.select("l_orderkey", "steps", iso(F.col("started")).alias("started"), iso(F.col("ended")).alias("ended"), F.round("amount", 2).alias("amount"))


@query("E16 N13", """SELECT CAST(sum(CASE WHEN user_id % 256 < 64 THEN 1 ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN user_id % 256 >= 64 AND user_id % 256 < 128 THEN 1 ELSE 0 END) AS BIGINT) AS mid,
count(*) AS n FROM events""")
def events_by_network(t):
    ip = F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"))
    return t.events.select(ip.alias("ip")).agg(F.count_if(net.in_network(F.col("ip"), "10.0.0.0/26")).alias("low"),
                                               F.count_if(net.in_network(F.col("ip"), "10.0.0.64/26")).alias("mid"), F.count(F.lit(1)).alias("n"))
