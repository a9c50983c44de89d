"""Every kind of row condition."""

from pyspark.sql import functions as F

from lumbre.functions.text import contains_phrase
from lumbre.operators import change
from lumbre.plans import panels, roles
from lumbre.queries.registry import query

import datetime as dt

TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query("F1 F2 F4 F5", "SELECT count(*) AS n FROM events WHERE (event_type IN ('error', 'view') AND value >= 10) AND NOT (event_type = 'view' AND value > 60)")
def combined_condition(t):
    k, v = F.col("event_type"), F.col("value")
    return t.events.where(k.isin("error", "view") & (v >= 10) & ~((k == "view") & (v > 60))).agg(F.count(F.lit(1)).alias("n"))


@query("F3 F21 N2", "SELECT CAST(count(*) FILTER (WHERE event_type <> 'view') AS BIGINT) AS present, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS absent FROM events")
def presence(t):
    k = F.when(F.col("event_type") != "view", F.col("event_type"))
    return t.events.select(k.alias("k")).agg(F.count_if(F.col("k").isNotNull()).alias("present"), F.count_if(F.col("k").isNull()).alias("absent"))


@query("F6 F7 N3", "SELECT month, count(*) AS n FROM (SELECT month(o_orderdate) AS month FROM orders WHERE o_orderdate >= '1996-03-01' AND o_orderdate < '1997-02-01' AND year(o_orderdate) = 1996) GROUP BY 1")
def half_open_range(t):
    rows = change.between(t.orders, "o_orderdate", dt.datetime(1996, 3, 1), dt.datetime(1997, 2, 1)).where(F.year("o_orderdate") == 1996)
    return rows.groupBy(F.month("o_orderdate").cast("bigint").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("F8 F9 F11", "SELECT count(*) AS n FROM pages WHERE regexp_matches(url, '^https?://[^/]+\\.example\\.(com|org)') AND contains(html, '<nav>') AND NOT contains(url, 'ref=')")
def pattern_conditions(t):
    u = F.col("url")
    return t.pages.where(u.rlike(r"^https?://[^/]+\.example\.(com|org)") & F.col("html").contains("<nav>") & ~u.contains("ref=")).agg(F.count(F.lit(1)).alias("n"))


@query("F12 N4", rf"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' of the ')")
def phrase_contains(t):
    return t.documents.where(contains_phrase(F.col("text"), "Of THE")).select("doc_id")


@query("F14 F16 D3", "SELECT CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS flagged, CAST(count(*) FILTER (WHERE value > 0) AS BIGINT) AS numeric, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS texts, "
       "CAST(count(*) FILTER (WHERE value >= 1) AS BIGINT) AS summed, CAST(count(*) FILTER (WHERE event_type IN ('error', 'click')) AS BIGINT) AS listed FROM events")
def critical_conditions(t):
    k = F.col("event_type")
    df = t.events.withColumns({"b": k == "error", "s": F.when(k == "view", k)})
    cond = lambda c: F.count_if(panels.critical_condition(df, c))
    return df.agg(cond("b").alias("flagged"), cond("value").alias("numeric"), cond("s").alias("texts"),
                  F.count_if(panels.critical_from_forecast("sum", "value")).alias("summed"),
                  F.count_if(panels.critical_from_forecast("filter", "event_type", ["error", "click"])).alias("listed"))


@query("F15", "SELECT CAST(count(*) FILTER (WHERE event_type IN ('error', 'purchase')) AS BIGINT) AS problems, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS named, count(*) AS n FROM events")
def level_problems(t):
    k = F.col("event_type")
    level = F.when(k == "error", F.lit("ERROR")).when(k == "purchase", F.lit("Alta")).when(k == "view", F.lit("notice")).when(k == "click", F.lit("Information"))
    df = t.events.select(level.alias("level"))
    return df.agg(F.count_if(panels.level_problem("level")).alias("problems"), F.count_if(panels.problem_levels("level", roles.PROBLEM_LEVEL)).alias("named"),
                  F.count(F.lit(1)).alias("n"))


@query("F17", """SELECT field, option, n FROM (SELECT 'event_type' AS field, event_type AS option, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2)
QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, option) <= 10""")
def control_options(t):
    return panels.controls(t.events, ["event_type", "user_id"]).select("field", "option", "n")


@query("F17 F2", "SELECT count(*) AS n FROM events WHERE event_type IN ('error', 'click') AND user_id IN (1, 2, 3, 5, 8)")
def controls_applied(t):
    return panels.apply_controls(t.events, {"event_type": ["error", "click"], "user_id": [1, 2, 3, 5, 8], "props": []}).agg(F.count(F.lit(1)).alias("n"))


@query("R17 R14 O3", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_id, user_id, event_type, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 100")
def saved_search(t):
    fields = [(0, "value", None, "measure"), (1, "user_id", None, "entity_id"), (2, "event_type", None, "primary_dimension"), (3, "ts", "date", None)]
    cols = panels.listing_columns(t.spark.createDataFrame(fields, "position int, path string, type string, role string"))
    out = panels.saved_search(t.events, "ts", cols, "event_id", 100, F.col("event_type") == "error")
    return out.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_id", *cols)
