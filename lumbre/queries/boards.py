"""Ready-made boards: every panel of a case as (panel, key, split, value) rows."""

from pyspark.sql import functions as F

from lumbre.plans import panels, profile as pf, roles
from lumbre.queries.registry import query
from lumbre.queries.security import siem_view

FMT = "'%Y-%m-%d %H:%M:%S'"


# SQL for one panel, written out from its parts.
def _m(title, agg, src, cond="true"):
    return f"SELECT '{title}' AS panel, '' AS key, '' AS split, round(CAST(coalesce({agg}, 0) AS DOUBLE), 4) AS value FROM {src} WHERE {cond}"


def _top(title, field, agg, src, cond="true", size=10):
    return (f"SELECT * FROM (SELECT '{title}' AS panel, CAST({field} AS VARCHAR) AS key, '' AS split, round(CAST(coalesce(v, 0) AS DOUBLE), 4) AS value FROM "
            f"(SELECT {field}, {agg} AS v FROM {src} WHERE ({cond}) AND {field} IS NOT NULL GROUP BY 1 ORDER BY v DESC, {field} LIMIT {size}))")


def _line(title, agg, ts, src, cond="true", split=None, size=5):
    keep = f"AND {split} IN (SELECT {split} FROM {src} WHERE ({cond}) AND {split} IS NOT NULL GROUP BY 1 ORDER BY {agg} DESC, {split} LIMIT {size})" if split else ""
    shown = f"CAST({split} AS VARCHAR)" if split else "''"
    return (f"SELECT '{title}' AS panel, strftime(date_trunc('day', {ts}), {FMT}) AS key, {shown} AS split, round(CAST(coalesce({agg}, 0) AS DOUBLE), 4) AS value "
            f"FROM {src} WHERE ({cond}) {keep} GROUP BY date_trunc('day', {ts}), {shown}")


def _all(*parts):
    return " UNION ALL ".join(parts)


_SIEM = """(SELECT event_id, ts, user_id, CASE event_type WHEN 'error' THEN 'waf' WHEN 'view' THEN 'cloudaudit' WHEN 'click' THEN 'auth' ELSE 'fortigate' END AS dataset,
CASE WHEN user_id % 5 = 0 THEN 'true' ELSE 'false' END AS threat, CASE WHEN event_type = 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'failure' ELSE 'success' END END AS outcome,
CASE WHEN value < 10 THEN 'T1003' END AS technique, CASE WHEN event_type = 'click' THEN CASE WHEN value > 30 THEN 'ssh_login' ELSE 'sudo' END WHEN event_type = 'view' THEN CASE WHEN value > 30 THEN 'createAccessKey' ELSE 'deleteTracker' END END AS action,
CASE WHEN user_id % 7 = 0 THEN 'root' WHEN user_id % 7 = 1 THEN 'contractor_ext' ELSE 'other' END AS user_name, CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 'sqli' WHEN value > 25 THEN 'webshell' ELSE 'xss' END END AS rule_name FROM events)"""


@query("2.18 A1 A4 A7 A10 F1 F5", _all(
    _m("events", "count(*)", _SIEM), _m("denied", "count(*)", _SIEM, "outcome = 'failure'"), _m("threat hits", "count(*)", _SIEM, "threat = 'true'"),
    _m("sources", "count(DISTINCT user_id)", _SIEM), _line("by source", "count(*)", "ts", _SIEM, split="dataset"),
    _top("blocked", "user_id", "count(*)", _SIEM, "dataset = 'fortigate' AND threat = 'true'"), _top("signatures", "rule_name", "count(*)", _SIEM),
    _line("logins", "count(*)", "ts", _SIEM, "dataset = 'auth'", "outcome"), _top("failed users", "user_name", "count(*)", _SIEM, "dataset = 'auth' AND outcome = 'failure'"),
    _top("cloud actions", "action", "count(*)", _SIEM, "dataset = 'cloudaudit'"), _line("threat line", "count(*)", "ts", _SIEM, "threat = 'true'"),
    _top("techniques", "technique", "count(*)", _SIEM)))
def board_siem(t):
    c = F.col
    view = siem_view(t).select("event_id", "ts", "user_id", c("event.dataset").alias("dataset"), c("event.outcome").alias("outcome"), c("event.action").alias("action"),
                               c("threat.matched").alias("threat_matched"), c("threat.technique.id").alias("technique"), c("user.name").alias("user_name"), c("rule.name").alias("rule_name"))
    return panels.board(view, [
        {"type": "metric", "title": "events"}, {"type": "metric", "title": "denied", "query": c("outcome") == "failure"},
        {"type": "metric", "title": "threat hits", "query": c("threat_matched")}, {"type": "metric", "title": "sources", "metric": "cardinality", "agg_field": "user_id"},
        {"type": "area", "title": "by source", "split": "dataset"},
        {"type": "table", "title": "blocked", "field": "user_id", "query": (c("dataset") == "fortigate") & (c("threat_matched"))},
        {"type": "bar", "title": "signatures", "field": "rule_name"}, {"type": "area", "title": "logins", "split": "outcome", "query": c("dataset") == "auth"},
        {"type": "table", "title": "failed users", "field": "user_name", "query": (c("dataset") == "auth") & (c("outcome") == "failure")},
        {"type": "bar", "title": "cloud actions", "field": "action", "query": c("dataset") == "cloudaudit"},
        {"type": "line", "title": "threat line", "query": c("threat_matched")}, {"type": "bar", "title": "techniques", "field": "technique"}], "ts")


@query("2.18 A1 A3 A7 A10", _all(
    _m("sessions", "count(*)", "events"), _m("blocked", "count(*)", "events", "event_type IN ('error', 'signup')"), _m("bytes", "sum(value)", "events"),
    _line("by action", "count(*)", "ts", "events", split="event_type"), _line("bandwidth", "sum(value)", "ts", "events"), _top("apps", "event_type", "count(*)", "events"),
    _top("sources", "user_id", "count(*)", "events"), _top("apps by bytes", "event_type", "sum(value)", "events"), _top("blocked ports", "user_id", "count(*)", "events", "event_type IN ('error', 'signup')")))
def board_firewall(t):
    blocked = F.col("event_type").isin("error", "signup")
    return panels.board(t.events, [
        {"type": "metric", "title": "sessions"}, {"type": "metric", "title": "blocked", "query": blocked}, {"type": "metric", "title": "bytes", "metric": "sum", "agg_field": "value"},
        {"type": "area", "title": "by action", "split": "event_type"}, {"type": "line", "title": "bandwidth", "metric": "sum", "agg_field": "value"}, {"type": "bar", "title": "apps", "field": "event_type"},
        {"type": "table", "title": "sources", "field": "user_id"}, {"type": "table", "title": "apps by bytes", "field": "event_type", "metric": "sum", "agg_field": "value"},
        {"type": "bar", "title": "blocked ports", "field": "user_id", "query": blocked}], "ts")


@query("2.18 A4 A31", _all(
    _m("transactions", "count(*)", "events"), _m("active accounts", "count(DISTINCT user_id)", "events"), _m("failed", "count(*)", "events", "event_type = 'error'"), _m("mean steps", "avg(value)", "events"),
    _line("dau", "count(DISTINCT user_id)", "ts", "events"), _line("by operation", "count(*)", "ts", "events", split="event_type"), _top("clients", "user_id", "count(*)", "events")))
def board_wallet(t):
    return panels.board(t.events, [
        {"type": "metric", "title": "transactions"}, {"type": "metric", "title": "active accounts", "metric": "cardinality", "agg_field": "user_id"},
        {"type": "metric", "title": "failed", "query": F.col("event_type") == "error"}, {"type": "metric", "title": "mean steps", "metric": "avg", "agg_field": "value"},
        {"type": "line", "title": "dau", "metric": "cardinality", "agg_field": "user_id"}, {"type": "area", "title": "by operation", "split": "event_type"},
        {"type": "table", "title": "clients", "field": "user_id"}], "ts")


@query("2.18 A3 A7 F2", _all(
    _m("orders", "count(*)", "orders"), _m("volume", "sum(o_totalprice)", "orders"), _m("clients", "count(DISTINCT o_custkey)", "orders"), _m("rejected", "count(*)", "orders", "o_orderstatus IN ('P', 'X')"),
    _top("top clients", "o_custkey", "sum(o_totalprice)", "orders"), _top("by priority", "o_orderpriority", "count(*)", "orders"), _top("reject reasons", "o_orderpriority", "count(*)", "orders", "o_orderstatus IN ('P', 'X')")))
def board_brokerage(t):
    bad = F.col("o_orderstatus").isin("P", "X")
    return panels.board(t.orders, [
        {"type": "metric", "title": "orders"}, {"type": "metric", "title": "volume", "metric": "sum", "agg_field": "o_totalprice"},
        {"type": "metric", "title": "clients", "metric": "cardinality", "agg_field": "o_custkey"}, {"type": "metric", "title": "rejected", "query": bad},
        {"type": "table", "title": "top clients", "field": "o_custkey", "metric": "sum", "agg_field": "o_totalprice"}, {"type": "bar", "title": "by priority", "field": "o_orderpriority"},
        {"type": "bar", "title": "reject reasons", "field": "o_orderpriority", "query": bad}], "o_orderdate")


@query("2.18 A1 A3 A4 A10", _all(
    _m("playback", "count(*)", "events"), _m("viewers", "count(DISTINCT user_id)", "events"), _m("seconds", "sum(value)", "events"), _m("errors", "count(*)", "events", "event_type = 'error'"),
    _line("errors over time", "count(*)", "ts", "events", "event_type = 'error'"), _line("seconds over time", "sum(value)", "ts", "events"), _top("titles", "user_id", "sum(value)", "events"),
    _top("errors by pop", "user_id", "count(*)", "events", "event_type = 'error'")))
def board_media(t):
    err = F.col("event_type") == "error"
    return panels.board(t.events, [
        {"type": "metric", "title": "playback"}, {"type": "metric", "title": "viewers", "metric": "cardinality", "agg_field": "user_id"}, {"type": "metric", "title": "seconds", "metric": "sum", "agg_field": "value"},
        {"type": "metric", "title": "errors", "query": err}, {"type": "area", "title": "errors over time", "query": err}, {"type": "line", "title": "seconds over time", "metric": "sum", "agg_field": "value"},
        {"type": "bar", "title": "titles", "field": "user_id", "metric": "sum", "agg_field": "value"}, {"type": "table", "title": "errors by pop", "field": "user_id", "query": err}], "ts")


@query("2.18 A3 A10", _all(
    _m("readings", "count(*)", "lineitem"), _m("oil", "sum(l_quantity)", "lineitem"), _m("stops", "count(*)", "lineitem", "l_returnflag = 'R'"), _line("oil by well", "sum(l_quantity)", "l_shipdate", "lineitem", split="l_suppkey"),
    _line("pressure", "avg(l_tax)", "l_shipdate", "lineitem"), _top("wells", "l_suppkey", "sum(l_quantity)", "lineitem"), _top("water", "l_suppkey", "sum(l_extendedprice)", "lineitem", "l_linestatus = 'F'")))
def board_wells(t):
    return panels.board(t.lineitem, [
        {"type": "metric", "title": "readings"}, {"type": "metric", "title": "oil", "metric": "sum", "agg_field": "l_quantity"}, {"type": "metric", "title": "stops", "query": F.col("l_returnflag") == "R"},
        {"type": "area", "title": "oil by well", "metric": "sum", "agg_field": "l_quantity", "split": "l_suppkey"}, {"type": "line", "title": "pressure", "metric": "avg", "agg_field": "l_tax"},
        {"type": "table", "title": "wells", "field": "l_suppkey", "metric": "sum", "agg_field": "l_quantity"},
        {"type": "bar", "title": "water", "field": "l_suppkey", "metric": "sum", "agg_field": "l_extendedprice", "query": F.col("l_linestatus") == "F"}], "l_shipdate")


@query("2.18 A3 A4 A7", _all(
    _m("orders", "count(*)", "orders"), _m("revenue", "sum(o_totalprice)", "orders"), _m("buyers", "count(DISTINCT o_custkey)", "orders"), _m("cancelled", "count(*)", "orders", "o_orderstatus = 'P'"),
    _top("by status", "o_orderstatus", "count(*)", "orders"), _top("buyers table", "o_custkey", "count(*)", "orders"), _top("makers", "o_orderpriority", "sum(o_totalprice)", "orders")))
def board_shop(t):
    return panels.board(t.orders, [
        {"type": "metric", "title": "orders"}, {"type": "metric", "title": "revenue", "metric": "sum", "agg_field": "o_totalprice"}, {"type": "metric", "title": "buyers", "metric": "cardinality", "agg_field": "o_custkey"},
        {"type": "metric", "title": "cancelled", "query": F.col("o_orderstatus") == "P"}, {"type": "bar", "title": "by status", "field": "o_orderstatus"},
        {"type": "table", "title": "buyers table", "field": "o_custkey"}, {"type": "table", "title": "makers", "field": "o_orderpriority", "metric": "sum", "agg_field": "o_totalprice"}], "o_orderdate")


_CLIN = "(SELECT *, CASE WHEN value > 80 THEN 'red' END AS triage FROM events)"


@query("2.18 A3 A4 F3", _all(
    _m("visits", "count(*)", _CLIN), _m("patients", "count(DISTINCT user_id)", _CLIN), _m("claims", "sum(value)", _CLIN), _m("critical", "count(*)", _CLIN, "triage IS NOT NULL"),
    _line("by class", "count(*)", "ts", _CLIN, split="event_type"), _line("urgent", "count(*)", "ts", _CLIN, "event_type IN ('error', 'signup')"), _top("cost", "event_type", "sum(value)", _CLIN)))
def board_clinic(t):
    df = t.events.withColumn("triage", F.when(F.col("value") > 80, F.lit("red")))
    return panels.board(df, [
        {"type": "metric", "title": "visits"}, {"type": "metric", "title": "patients", "metric": "cardinality", "agg_field": "user_id"}, {"type": "metric", "title": "claims", "metric": "sum", "agg_field": "value"},
        {"type": "metric", "title": "critical", "query": F.col("triage").isNotNull()}, {"type": "area", "title": "by class", "split": "event_type"},
        {"type": "area", "title": "urgent", "query": F.col("event_type").isin("error", "signup")}, {"type": "bar", "title": "cost", "field": "event_type", "metric": "sum", "agg_field": "value"}], "ts")


@query("2.18 A1 A4 A7", _all(
    _m("traces", "count(*)", "events"), _m("users", "count(DISTINCT user_id)", "events"), _top("actions", "event_type", "count(*)", "events", size=15), _top("ratings", "event_type", "count(*)", "events"),
    _line("traces over time", "count(*)", "ts", "events", split="event_type")))
def board_cloud_audit(t):
    return panels.board(t.events, [
        {"type": "metric", "title": "traces"}, {"type": "metric", "title": "users", "metric": "cardinality", "agg_field": "user_id"}, {"type": "tagcloud", "title": "actions", "field": "event_type"},
        {"type": "pie", "title": "ratings", "field": "event_type"}, {"type": "area", "title": "traces over time", "split": "event_type"}], "ts")


_FRAUD = "(SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_fraud FROM events)"


@query("2.18 A3 F1 A7", _all(
    _m("transactions", "count(*)", _FRAUD), _m("fraudulent", "count(*)", _FRAUD, "is_fraud = 1"), _m("fraud amount", "sum(value)", _FRAUD, "is_fraud = 1"), _m("mean amount", "avg(value)", _FRAUD),
    _line("by fraud", "count(*)", "ts", _FRAUD, split="is_fraud"), _top("devices", "user_id", "count(*)", _FRAUD, "is_fraud = 1")))
def board_fraud(t):
    df = t.events.withColumn("is_fraud", F.when(F.col("event_type") == "error", 1).otherwise(0))
    hit = F.col("is_fraud") == 1
    return panels.board(df, [
        {"type": "metric", "title": "transactions"}, {"type": "metric", "title": "fraudulent", "query": hit}, {"type": "metric", "title": "fraud amount", "metric": "sum", "agg_field": "value", "query": hit},
        {"type": "metric", "title": "mean amount", "metric": "avg", "agg_field": "value"}, {"type": "area", "title": "by fraud", "split": "is_fraud"}, {"type": "table", "title": "devices", "field": "user_id", "query": hit}], "ts")


@query("2.18 T20", _all(
    _m("events", "count(*)", "events"), _m("sum value", "sum(value)", "events"), _line("events over time", "count(*)", "ts", "events", split="event_type"), _top("by event_type", "event_type", "count(*)", "events"),
    _top("top event_type by value", "event_type", "sum(value)", "events")))
def board_automatic(t):
    df = t.events.select("ts", "event_type", "value")
    p = roles.with_roles(pf.profile(df, "events"))
    parts = roles.classify(p).first().asDict()
    kinds = {r["column"]: r["type"] for r in pf.plan_rows(p)}
    return panels.board(df, panels.automatic_boards(parts, kinds)["summary"], "ts")


@query("2.18 A1 A3 A7 A9 A32", _all(
    "SELECT 'how many' AS question, '' AS answer, CAST(count(*) AS DOUBLE) AS value FROM events",
    "SELECT 'most frequent', event_type, CAST(n AS DOUBLE) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)",
    "SELECT 'largest total', CAST(user_id AS VARCHAR), round(v, 2) FROM (SELECT user_id, sum(value) AS v FROM events GROUP BY 1 ORDER BY v DESC, 1 LIMIT 1)",
    f"SELECT 'busiest day', strftime(d, {FMT}), CAST(n AS DOUBLE) FROM (SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)"))
def question_templates(t):
    from lumbre.functions.dates import iso
    from lumbre.operators import aggregates as ag
    e = t.events
    one = lambda q, df, a, v: df.select(F.lit(q).alias("question"), a.cast("string").alias("answer"), v.cast("double").alias("value"))
    days = e.withColumn("day", F.date_trunc("day", "ts"))
    return one("how many", e.agg(F.count(F.lit(1)).alias("n")), F.lit(""), F.col("n")) \
        .unionByName(one("most frequent", ag.most_frequent(e, "event_type"), F.col("event_type"), F.col("value"))) \
        .unionByName(one("largest total", ag.top_terms(e, "user_id", 1, F.sum("value")), F.col("user_id"), F.round("value", 2))) \
        .unionByName(one("busiest day", ag.top_terms(days, "day", 1), iso(F.col("day")), F.col("value")))
