"""Entity profiles, rollups, distinct texts, templates and funnels."""

from pyspark.sql import functions as F

from lumbre.functions.dates import iso
from lumbre.operators import derived
from lumbre.queries.registry import query

FMT = "'%Y-%m-%d %H:%M:%S'"


@query("A21 A22 A33 D1 D2", f"""SELECT user_id AS entity, count(*) AS events, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS critical, round(sum(value), 2) AS sum_value,
round(coalesce(avg(value) FILTER (WHERE event_type = 'purchase'), 0), 6) AS avg_amount, coalesce(max(value) FILTER (WHERE event_type = 'purchase'), 0) AS max_amount,
strftime(max(ts), {FMT}) AS last FROM events GROUP BY 1""")
def entity_profile_users(t):
    e = t.events.withColumns({"failed": F.when(F.col("event_type") == "error", F.lit("error")), "amount": F.when(F.col("event_type") == "purchase", F.col("value"))})
    p = derived.entity_profile(e, "user_id", "ts", [("value", "sum"), ("amount", "avg"), ("amount", "max")], "failed")
    return p.select("entity", "events", "critical", F.round("sum_value", 2).alias("sum_value"), F.round("avg_amount", 6).alias("avg_amount"), "max_amount",
                    iso(F.col("last")).alias("last"))


@query("O6", "SELECT user_id AS entity, count(*) AS events FROM events GROUP BY 1 ORDER BY events DESC, entity LIMIT 15")
def entity_profile_top15(t):
    return derived.profile_order(derived.entity_profile(t.events, "user_id", "ts"), "events").select("entity", "events")


@query("A23", f"""SELECT strftime(date_trunc('hour', ts), {FMT}) AS hour, event_type, count(*) AS events, round(sum(value), 2) AS value_sum, round(avg(value), 6) AS value_avg,
min(value) AS value_min, max(value) AS value_max, count(value) AS value_count, count(user_id) AS user_id_count FROM events GROUP BY 1, 2""")
def hourly_rollup_events(t):
    r = derived.hourly_rollup(t.events, "ts", ["event_type"], ["value", "user_id"], count_only=("user_id",))
    return r.withColumns({"hour": iso(F.col("hour")), "value_sum": F.round("value_sum", 2), "value_avg": F.round("value_avg", 6)})


@query("A24 A23", f"""SELECT strftime(date_trunc('day', ts), {FMT}) AS bucket, count(*) AS events, round(sum(value), 2) AS value_sum, min(value) AS value_min, max(value) AS value_max,
round(avg(value), 6) AS value_avg, count(value) AS value_count FROM events GROUP BY 1""")
def rollup_requery_daily(t):
    r = derived.hourly_rollup(t.events, "ts", ["event_type"], ["value"])
    out = derived.requery_rollup(derived.answer_from(r, t.events, [], ["value"]), "day", [], ["value"])
    return out.withColumns({"bucket": iso(F.col("bucket")), "value_sum": F.round("value_sum", 2), "value_avg": F.round("value_avg", 6)})


@query("A25", "SELECT md5(text) AS digest, count(*) AS count FROM conversations GROUP BY text")
def distinct_texts(t):
    return derived.distinct_texts(t.conversations, "text").select(F.md5("text").alias("digest"), "count")


@query("A26", r"""SELECT regexp_replace(c_name, '\b\d+\b', '<num>', 'g') AS template, count(*) AS count FROM (SELECT 'order ' || o_orderkey || ' of customer ' || o_custkey || ' is ' || o_orderstatus AS c_name FROM orders) GROUP BY 1""")
def order_templates(t):
    msg = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of customer "), F.col("o_custkey").cast("string"), F.lit(" is "), F.col("o_orderstatus"))
    return derived.text_templates(t.orders.select(msg.alias("m")), "m").select("template", "count")


@query("A26")
def text_templates(t):
    return derived.text_templates(t.conversations, "text")


@query("A26", """SELECT 'part <*> ready' AS template, count(*) AS count FROM part HAVING count(DISTINCT p_brand) > 8""")
def merged_templates(t):
    msg = F.concat(F.lit("part "), F.col("p_brand"), F.lit(" ready"))
    # Brand names hold a digit run that is masked only when it stands alone, so the second pass merges them.
    return derived.merged_templates(derived.text_templates(t.part.select(F.regexp_replace(msg, "#", "").alias("m")), "m")).select("template", "count")


@query("A28", """WITH s AS (SELECT l_orderkey, l_linenumber, 'step' || l_linenumber AS code, l_linestatus = 'F' AS ok FROM lineitem),
d AS (SELECT l_orderkey, l_linenumber, code, ok FROM s)
SELECT l_orderkey, count(*) AS steps_total, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS steps_completed, max(struct_pack(i := l_linenumber, c := code)).c AS last_step_code,
coalesce((max(struct_pack(i := l_linenumber, c := code)) FILTER (WHERE ok)).c, '') AS deepest_ok_code,
coalesce((min(struct_pack(i := l_linenumber, c := code)) FILTER (WHERE NOT ok)).c, '') AS failed_at_code,
CASE WHEN count(*) FILTER (WHERE ok) < count(*) THEN 1 ELSE 0 END AS failed FROM d GROUP BY 1""")
def order_status_funnel(t):
    s = t.lineitem.withColumn("code", F.concat(F.lit("step"), F.col("l_linenumber").cast("string")))
    f = derived.funnel_from_rows(s, "l_orderkey", "l_linenumber", "code", F.col("l_linestatus") == "F")
    return f.withColumns({"failed": F.col("failed").cast("int"), "deepest_ok_code": F.coalesce("deepest_ok_code", F.lit("")),
                          "failed_at_code": F.coalesce("failed_at_code", F.lit(""))})


@query("A29", "SELECT 'step' || l_linenumber AS code, count(DISTINCT l_orderkey) AS reached FROM lineitem GROUP BY 1")
def funnel_reach(t):
    s = t.lineitem.select("l_orderkey", F.concat(F.lit("step"), F.col("l_linenumber").cast("string")).alias("code"))
    return derived.funnel_reach(s, "l_orderkey", "code")


@query("A28 N10 W8 P9", """SELECT l_linenumber, l_returnflag, l_linestatus, count(*) AS n, CAST(sum(3) AS BIGINT) AS steps, CAST(sum(1 + CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END + CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END) AS BIGINT) AS completed,
max(CASE WHEN l_returnflag = 'R' THEN 'check' WHEN l_linestatus <> 'F' THEN 'confirm' ELSE '' END) AS failed_at FROM lineitem GROUP BY 1, 2, 3""")
def step_array_funnel(t):
    step = lambda code, i, ok: F.struct(F.lit(code).alias("code"), F.lit(str(i)).alias("index"), F.when(ok, F.lit("C")).otherwise(F.lit("E")).alias("status"),
                                        F.lit("False").alias("timedout"), F.lit("False").alias("lateResp"))
    steps = F.array(step("confirm", 10, F.col("l_linestatus") == "F"), step("validate", 0, F.lit(True)), step("check", 2, F.col("l_returnflag") != "R"))
    doc = F.to_json(F.struct(F.struct(steps.alias("steps")).alias("data")))
    parsed = F.from_json(doc, "data struct<steps:array<struct<code:string,index:string,status:string,timedout:string,lateResp:string>>>")
    df = t.spread("lineitem", "l_linenumber", "l_returnflag", "l_linestatus").select("l_linenumber", "l_returnflag", "l_linestatus", parsed.alias("p")).withColumn("f", derived.funnel(F.col("p.data.steps")))
    return df.groupBy("l_linenumber", "l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("f.steps_total").alias("steps"), F.sum("f.steps_completed").alias("completed"),
        F.max(F.coalesce("f.failed_at_code", F.lit(""))).alias("failed_at"))


@query("A34 N15 N16", f"""SELECT strftime(to_timestamp(epoch_ms(ts) // 1000) AT TIME ZONE 'UTC', {FMT}) AS hora, event_type || '-idx' AS indices, CAST(round(value) AS BIGINT) AS latencia_ms,
round(value * 1000 / 1e6, 1) AS cpu_ms, round(user_id / 1024.0, 1) AS memoria_kb, CASE event_type WHEN 'view' THEN 'agregación (sum, terms)' WHEN 'click' THEN 'conteo total' ELSE 'búsqueda con filtro' END AS forma, 3 AS shards
FROM events WHERE event_type <> 'error' ORDER BY value DESC, epoch_ms(ts) LIMIT 15""")
def query_log_top(t):
    k = F.col("event_type")
    number = lambda c: F.struct(c.cast("double").alias("number"))
    index = F.when(k == "error", F.lit(".internal")).otherwise(F.concat(k, F.lit("-idx")))
    source = F.when(k == "view", F.lit('{"aggs":{"a":{"terms":{"field":"x"},"aggs":{}},"b":{"sum":{"field":"y"}}}}')).when(k == "click", F.lit('{"size":0}')) \
        .otherwise(F.lit('{"query":{"match_all":{}}}'))
    log = t.events.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.array(index).alias("indices"), source.alias("source"), F.lit(3).alias("total_shards"),
                          F.struct(number(F.col("value")).alias("latency"), number(F.col("value") * 1000).alias("cpu"), number(F.col("user_id")).alias("memory")).alias("measurements"))
    return derived.query_log_summary(log, "latency")
