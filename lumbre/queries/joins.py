"""Lookups, correlations and time joins."""

from pyspark.sql import functions as F

from lumbre.functions import net
from lumbre.functions.dates import iso
from lumbre.operators import joins, scan
from lumbre.queries.registry import query

FMT = "'%Y-%m-%d %H:%M:%S'"
FMTU = "'%Y-%m-%d %H:%M:%S.%f'"


def micro(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("J1 A17 F5", """SELECT user_id, errors, purchases FROM (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1)
JOIN (SELECT user_id, count(*) AS purchases FROM events WHERE event_type = 'purchase' GROUP BY 1) USING (user_id)""")
def correlate_error_purchase_users(t):
    k = F.col("event_type")
    return joins.correlate_aggregates(t.events, "user_id", k == "error", k == "purchase", "errors", "purchases")


@query("J2", f"""SELECT e.user_id, strftime(e.ts, {FMTU}) AS at, count(*) AS n_right FROM (SELECT * FROM events WHERE event_type = 'error') e
JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND p.ts BETWEEN e.ts AND e.ts + INTERVAL 1 HOUR GROUP BY 1, 2""")
def correlate_error_then_purchase_1h(t):
    k = F.col("event_type")
    m = joins.window_matches(t.events.where(k == "error"), t.events.where(k == "purchase"), "user_id", "ts", 3600, before=False)
    return m.select("user_id", micro("ts").alias("at"), "n_right")


@query("J2", f"""WITH p AS (SELECT e.user_id, e.ts, count(*) AS m FROM (SELECT * FROM events WHERE event_type = 'error') e
JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND v.ts BETWEEN e.ts - INTERVAL 2 HOUR AND e.ts + INTERVAL 2 HOUR GROUP BY 1, 2)
SELECT user_id, count(*) AS left_findings, CAST(sum(m) AS BIGINT) AS matches, strftime(min(ts), {FMT}) AS first_at, strftime(max(ts), {FMT}) AS last_at FROM p GROUP BY 1""")
def correlate_within_2h(t):
    k = F.col("event_type")
    out = joins.correlate_within(t.events.where(k == "error"), t.events.where(k == "view"), "user_id", "ts", 120)
    return out.select("user_id", "left_findings", "matches", iso(F.col("first_at")).alias("first_at"), iso(F.col("last_at")).alias("last_at"))


def _pair(a, b):
    return (f"SELECT '{a}-{b}' AS pair, count(DISTINCT x.event_id) AS findings, count(*) AS matches FROM (SELECT * FROM events WHERE event_type = '{a}') x "
            f"JOIN (SELECT * FROM events WHERE event_type = '{b}') y ON x.user_id = y.user_id AND y.ts BETWEEN x.ts - INTERVAL 1 HOUR AND x.ts + INTERVAL 1 HOUR")


@query("J3", " UNION ALL ".join(_pair(a, b) for a, b in (("error", "view"), ("error", "click"), ("error", "signup"), ("view", "click"), ("view", "signup"), ("click", "signup"))))
def correlate_source_pairs(t):
    sources = {k: t.events.where(F.col("event_type") == k) for k in ("error", "view", "click", "signup")}
    return joins.correlate_sources(sources, "user_id", "ts", 60).groupBy("pair") \
        .agg(F.sum("left_findings").alias("findings"), F.sum("matches").alias("matches"))


@query("J4 J5", """SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def lookup_nation_left(t):
    nations = t.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.lookup(t.customer, nations, "c_nationkey", ["n_name"]).groupBy("n_name") \
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("J4", """SELECT CASE WHEN c_custkey IS NULL THEN 'unknown' ELSE c_mktsegment END AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey GROUP BY 1""")
def orders_with_identity(t):
    identity = t.customer.where(F.col("c_custkey") % 7 != 0).withColumnRenamed("c_custkey", "o_custkey")
    out = joins.lookup(t.orders, identity, "o_custkey", ["c_mktsegment"])
    return out.groupBy(F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("J6 F10 E15", """SELECT s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 1 ELSE 0 END AS matched FROM supplier""")
def threat_list_flag(t):
    listed = t.nation.where(F.col("n_regionkey") == 1)
    return joins.flag_listed(t.supplier, "s_nationkey", listed, "n_nationkey").select("s_suppkey", F.col("matched").cast("int").alias("matched"))


@query("J7", f"""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), s AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
c AS (SELECT event_id, s.value, s.ts AS near, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(s.ts) - epoch_us(p.ts)), s.ts) AS r
FROM p JOIN s ON p.user_id = s.user_id AND abs(epoch_us(s.ts) - epoch_us(p.ts)) <= 43200000000)
SELECT event_id, coalesce(value, -1) AS nearest_value, coalesce(strftime(near, {FMTU}), '') AS nearest_ts FROM p LEFT JOIN (SELECT * FROM c WHERE r = 1) USING (event_id)""")
def nearest_event_tolerance(t):
    k = F.col("event_type")
    points = t.events.where(k == "view").groupBy("user_id", "ts").agg(F.min("value").alias("value"))
    out = joins.nearest(t.events.where(k == "error").select("event_id", "user_id", "ts"), points, ["user_id"], "ts", "value", 43_200_000_000)
    return out.select("event_id", F.coalesce("nearest_value", F.lit(-1.0)).alias("nearest_value"), F.coalesce(micro("nearest_ts"), F.lit("")).alias("nearest_ts"))


@query("J8", "SELECT count(*) AS judged, CAST(count(*) FILTER (WHERE d.doc_id IS NOT NULL) AS BIGINT) AS found FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE lang <> 'de') d USING (doc_id)")
def judged_texts_found(t):
    texts = t.documents.where("lang <> 'de'").select(F.col("doc_id").cast("string").alias("text"), "doc_id")
    judged = t.labels.select(F.col("doc_id").cast("string").alias("text"), F.col("quality").alias("rating"))
    return joins.share_found(judged, texts, "text", "doc_id").agg(F.count(F.lit(1)).alias("judged"), F.count_if("found").alias("found"))


@query("J11", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 20) GROUP BY 1")
def orders_of_top_customers(t):
    from lumbre.operators.aggregates import keep_top
    return keep_top(t.orders, "o_custkey", 20, F.sum("o_totalprice")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("J12", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def customers_without_closed_orders(t):
    closed = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(closed, "c_custkey", "left_anti").select("c_custkey")


@query("W6", f"""SELECT o_custkey, prev AS previous, o_orderkey, o_orderkey - prev - 1 AS missing FROM
(SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders) WHERE o_orderkey - prev > 1""")
def sequence_gaps(t):
    return scan.sequence_gaps(t.orders, ["o_custkey"], "o_orderkey", 1000)


@query("W7", f"""SELECT o_orderkey, CAST((epoch_us(seen) - epoch_us(o_orderdate)) // 1000 AS BIGINT) AS late_ms FROM
(SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM orders) WHERE seen > o_orderdate""")
def late_arrivals(t):
    return scan.out_of_order(t.orders, ["o_custkey"], "o_orderkey", "o_orderdate", 1000).select("o_orderkey", "late_ms")


@query("W6", """WITH s AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'view' THEN 3 ELSE 1 END AS step, event_type = 'signup' AS reset FROM events),
r AS (SELECT *, sum(step) OVER w AS run FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, last_value(CASE WHEN reset THEN run - step END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS base FROM r)
SELECT event_id, CAST(run - coalesce(base, 0) AS BIGINT) AS sequence FROM b""")
def numbering_with_resets(t):
    k = F.col("event_type")
    out = scan.sequence_numbers(t.events, ["user_id"], "ts", "event_id", k == "signup", F.when(k == "view", 3).otherwise(1))
    return out.select("event_id", "sequence")


@query("E12", f"""WITH e AS (SELECT user_id, ts, event_type FROM events WHERE event_type IN ('signup', 'purchase')),
s AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM e)
SELECT user_id, strftime(ts, {FMTU}) AS at, round((epoch_us(ts) - epoch_us(since)) / 1e6, 3) AS elapsed_s FROM s WHERE event_type = 'purchase' AND since IS NOT NULL""")
def signup_to_purchase_elapsed(t):
    k = F.col("event_type")
    out = joins.elapsed(t.events, ["user_id"], "ts", k == "signup", k == "purchase")
    return out.select("user_id", micro("ts").alias("at"), F.round("elapsed_s", 3).alias("elapsed_s"))


# a third of the addresses each IPv4, mapped and IPv6
@query("E7 E16 N13", """WITH e AS (SELECT event_id % 3 AS kind, user_id * 65537 % 1600 AS k FROM events)
SELECT CASE kind WHEN 0 THEN 'v4' WHEN 1 THEN 'mapped' ELSE 'v6' END AS kind, n_name, count(*) AS n, CAST(sum(CASE WHEN kind < 2 AND k < 256 OR kind = 2 AND k < 1024 THEN 1 ELSE 0 END) AS BIGINT) AS near
FROM e LEFT JOIN nation ON k >= n_nationkey * 64 AND k < n_nationkey * 64 + 60 GROUP BY ALL""")
def mixed_address_places(t):
    k, kind = F.col("user_id") * 65537 % 1600, F.col("event_id") % 3
    v4 = F.concat_ws(".", F.lit("10"), F.lit("0"), F.floor(k / 256).cast("string"), (k % 256).cast("string"))
    ip = F.when(kind == 0, v4).when(kind == 1, F.concat(F.lit("::ffff:"), v4)).otherwise(F.concat(F.lit("2001:DB8::"), F.hex(k.cast("bigint"))))
    as_v4 = lambda x: F.concat_ws(".", F.lit("10"), F.lit("0"), F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    as_v6 = lambda x: F.concat(F.lit("2001:db8:0:0::"), F.hex(x.cast("bigint")))
    lo, hi = F.col("n_nationkey") * 64, F.col("n_nationkey") * 64 + 59
    ranges = t.nation.select(as_v4(lo).alias("start"), as_v4(hi).alias("end"), "n_name").unionByName(t.nation.select(as_v6(lo).alias("start"), as_v6(hi).alias("end"), "n_name"))
    rows = t.events.select(F.when(kind == 0, "v4").when(kind == 1, "mapped").otherwise("v6").alias("kind"), ip.alias("ip"))
    near = net.in_network(F.col("ip"), "10.0.0.0/24", "2001:db8::/118")
    return joins.address_places(rows, "ip", ranges, ["n_name"]).groupBy("kind", "n_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("near"))


@query("E7", """SELECT n_name, count(*) AS n FROM (SELECT user_id * 65537 % 1600 AS k FROM events) JOIN nation ON k >= n_nationkey * 64 AND k < n_nationkey * 64 + 60 GROUP BY 1""")
def geoip_places(t):
    k = F.col("user_id") * 65537 % 1600
    ip = F.concat_ws(".", F.lit("10"), F.lit("0"), F.floor(k / 256).cast("string"), (k % 256).cast("string"))
    base = 10 * 256 ** 3
    ranges = t.nation.select((base + F.col("n_nationkey") * 64).cast("bigint").alias("start"), (base + F.col("n_nationkey") * 64 + 59).cast("bigint").alias("end"), "n_name")
    out = joins.geoip(t.events.select(ip.alias("ip")), "ip", ranges, ["n_name"])
    return out.where(F.col("n_name").isNotNull()).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
