"""Profiles, types and rules over columns, across whole tables."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lumbre.plans import profile as pf, roles
from lumbre.queries.registry import query


def _profile_sql(table: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        v = f"CASE WHEN lower(trim(CAST({c} AS VARCHAR))) IN ('', '-', '--', 'n/a', 'null', 'none', 'nan', 'nil', 's/d', '#n/a', 'undefined') THEN NULL ELSE CAST({c} AS VARCHAR) END"
        parts.append(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({v}) AS empties, count(DISTINCT {v}) AS \"distinct\" FROM {table}")
    return " UNION ALL ".join(parts)


@query("T1", _profile_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def profile_columns(t):
    return pf.profile(t.customer, "customer").select("column", "rows", "empties", "distinct")


@query("T1", """SELECT column_name AS "column", value, n FROM (
SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL
SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY 2)
QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) <= 8""")
def top_values_per_column(t):
    from lumbre.operators.aggregates import top_per_group
    counts = pf.value_counts(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"]).where(F.col("value").isNotNull())
    return top_per_group(counts, ["column"], [F.desc("n"), F.asc("value")], pf.TOP_VALUES).select("column", "value", "n")


@query("T1 A4")
def profile_columns_sketch(t):
    return pf.profile(t.customer, "customer", exact=False).select("column", "rows", "empties", "distinct", "frequent", "type")


def _text_orders(t) -> DataFrame:
    """Orders as a delimited export would bring them: all text, local numbers and dates."""
    o = t.orders
    return o.select(F.col("o_orderkey").cast("string").alias("order_id"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("fecha"),
                    F.translate(F.format_number("o_totalprice", 2), ",.", ".,").alias("importe"), F.col("o_orderstatus").alias("estado"),
                    (F.col("o_custkey") % 50).cast("string").alias("cantidad"), F.lpad((F.col("o_orderkey") % 90).cast("string"), 4, "0").alias("sucursal"),
                    F.when(F.col("o_orderstatus") == "O", F.lit("true")).otherwise(F.lit("no")).alias("abierta"),
                    F.concat(F.lit("10.0.0."), (F.col("o_custkey") % 250).cast("string")).alias("origen"))


@query("T2 T3 T4 T6 T9", """SELECT * FROM (VALUES ('order_id', 'string', '', '', 0), ('fecha', 'date', 'dd/MM/yyyy', '', 0), ('importe', 'float', '', ',', 0), ('estado', 'string', '', '', 1),
('cantidad', 'integer', '', '.', 0), ('sucursal', 'string', '', '', 1), ('abierta', 'boolean', '', '', 1), ('origen', 'ip', '', '', 0)) AS v("column", type, date_format, decimal, dimension)""")
def inferred_types(t):
    p = pf.profile(_text_orders(t), "orders")
    return p.select("column", "type", F.coalesce("date_format", F.lit("")).alias("date_format"), F.coalesce("decimal", F.lit("")).alias("decimal"),
                    F.col("dimension").cast("int").alias("dimension"))


@query("T7 T14 R2", "SELECT count(*) AS total, count(*) AS ok, CAST(0 AS BIGINT) AS failed FROM orders")
def typed_rows_verified(t):
    text = _text_orders(t)
    return pf.verify(pf.apply_plan(text, pf.plan_rows(pf.profile(text)), None))


@query("T14", "SELECT count(*) AS total, CAST(count(*) FILTER (WHERE o_orderkey % 10 <> 3) AS BIGINT) AS ok, CAST(count(*) FILTER (WHERE o_orderkey % 10 = 3) AS BIGINT) AS failed FROM orders")
def typed_rows_with_problems(t):
    text = _text_orders(t)
    plan = pf.plan_rows(pf.profile(text))
    broken = text.withColumn("importe", F.when(F.col("order_id").cast("bigint") % 10 == 3, F.lit("1.23.4")).otherwise(F.col("importe")))
    return pf.verify(pf.apply_plan(broken, plan, None))


def _catalogue(t, *names: str) -> DataFrame:
    # One profile per table; each is a single aggregate of its own scan.
    return reduce(DataFrame.unionByName, [pf.profile(getattr(t, n), n, exact=False) for n in names])


@query("T13", """SELECT * FROM (VALUES ('events', 'ts', 'timestamp'), ('events', 'value', 'measure'), ('events', 'event_id', 'entity_id'), ('events', 'user_id', 'entity_id'), ('events', 'event_type', ''), ('events', 'props', '')) AS v("table", "column", role)""")
def event_roles(t):
    p = roles.with_roles(pf.profile(t.events.withColumn("value", F.col("value")), "events"))
    return p.select("table", "column", F.coalesce("role", F.lit("")).alias("role"))


@query("T13 T19 T24")
def catalogue_roles(t):
    p = roles.with_roles(_catalogue(t, "nation", "customer", "orders", "supplier"))
    return p.select("table", "column", "type", "role", "default_agg", "is_rate", "sensitive")


@query("T18", """SELECT * FROM (VALUES ('shop', 'customer.name')) AS v("table", entity)""")
def proposed_entity(t):
    df = t.orders.select(F.col("o_orderkey").cast("string").alias("order.id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer.name"),
                         F.col("o_orderpriority").alias("host.name"))
    return roles.entity(pf.profile(df, "shop"))


@query("T19", """SELECT * FROM (VALUES ('shop', 'amount_total', 'sum', 1), ('shop', 'latency_ms', 'avg', 1), ('shop', 'unit_price', 'avg', 2)) AS v("table", "column", agg, rank)""")
def proposed_measures(t):
    df = t.lineitem.select(F.col("l_extendedprice").alias("amount_total"), F.col("l_quantity").alias("quantity"), (F.col("l_tax") * 100).alias("latency_ms"),
                           F.col("l_discount").alias("unit_price"))
    return roles.measures(roles.with_roles(pf.profile(df, "shop")))


@query("T20")
def board_parts(t):
    return roles.classify(_catalogue(t, "orders", "events", "conversations"))


@query("T15 J13 U3", """SELECT * FROM (VALUES ('c_acctbal', 'changed', 'float', 'string'), ('c_name', 'missing', 'string', ''), ('note', 'extra', '', 'string')) AS v("column", change, "before", "after")""")
def schema_diff(t):
    before = pf.profile(t.customer.select("c_custkey", "c_name", "c_acctbal", F.lit("x").alias("c_mktsegment")), "a")
    after = pf.profile(t.customer.select("c_custkey", F.concat(F.lit("n/d "), F.col("c_acctbal").cast("string")).alias("c_acctbal"), "c_mktsegment", F.lit("y").alias("note")), "b")
    d = pf.compare(before, after)
    return d.select("column", "change", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))


@query("T16", """SELECT "column", "distinct", array_to_string(list_sort(v), ',') AS "values" FROM (
SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS "distinct", list(DISTINCT o_orderstatus) AS v FROM orders UNION ALL
SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), list(DISTINCT o_orderpriority) FROM orders) WHERE "distinct" <= 15""")
def enum_columns(t):
    return pf.enums(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"]).withColumn("values", F.array_join("values", ","))


@query("T17", """SELECT dimension, round(coverage, 6) AS coverage FROM (SELECT 'a' AS dimension, avg(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) AS coverage FROM events UNION ALL
SELECT 'b', avg(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) FROM events) WHERE coverage >= 0.5""")
def dimension_coverage(t):
    k = F.col("event_type")
    df = t.events.select(F.col("props").alias("text"), F.when(k != "view", k).alias("a"), F.when(k == "view", k).alias("b"))
    return pf.coverage(df, "text", ["a", "b"]).withColumn("coverage", F.round("coverage", 6))


@query("T25", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, CAST(sum(strlen(props)) AS BIGINT) AS bytes, round(avg(strlen(props)), 4) AS bytes_per_event FROM events GROUP BY 1")
def daily_volume(t):
    return pf.volume(t.events, "props", F.date_format("ts", "yyyy-MM-dd")).withColumn("bytes_per_event", F.round("bytes_per_event", 4))


# the paths that all rows of the table spell, in three spellings, against a table of standard fields
@query("T21 R4", """WITH e AS (SELECT DISTINCT event_type AS k FROM events), j AS (SELECT DISTINCT unnest(json_keys(props)) AS k FROM events),
p AS (SELECT '[Event][' || upper(k[1]) || k[2:] || ']' AS "column", 'event.' || k AS normalized FROM e UNION ALL SELECT ' Props.' || upper(k) || ' ', 'props.' || k FROM j UNION ALL SELECT k, k FROM e),
spec AS (SELECT * FROM (VALUES ('event.click', 'keyword'), ('event.view', 'keyword'), ('props.k', 'long'), ('user.name', 'keyword')) AS v(normalized, type))
SELECT "column", normalized, coalesce(type, '') AS standard_type, CAST(type IS NOT NULL AS INTEGER) AS is_standard FROM p LEFT JOIN spec USING (normalized)""")
def standard_paths(t):
    k = F.col("event_type")
    spelled = F.array_union(F.array(F.concat(F.lit("[Event]["), F.initcap(k), F.lit("]")), k), F.transform(F.json_object_keys("props"), lambda x: F.concat(F.lit(" Props."), F.upper(x), F.lit(" "))))
    fields = t.events.select(F.explode(spelled).alias("column")).distinct()
    spec = t.spark.createDataFrame([("event.click", "keyword"), ("Event.View", "keyword"), ("props.k", "long"), ("user.name", "keyword")], "field string, type string")
    out = roles.classify_paths(fields, spec)
    return out.select("column", "normalized", F.coalesce("standard_type", F.lit("")).alias("standard_type"), F.col("is_standard").cast("int").alias("is_standard"))


@query("T23", """SELECT CASE WHEN bool_and(c_custkey % 90 BETWEEN -90 AND 90) THEN 'geo_lat' ELSE '' END AS lat, CASE WHEN bool_and(c_custkey % 180 BETWEEN -180 AND 180) THEN 'geo_long' ELSE '' END AS lon,
CASE WHEN bool_and(regexp_full_match(c_name, '-?[0-9.]+,-?[0-9.]+')) THEN 'location' ELSE '' END AS pair FROM customer""")
def geo_columns(t):
    df = t.customer.select((F.col("c_custkey") % 90).cast("double").alias("geo_lat"), (F.col("c_custkey") % 180).cast("double").alias("geo_long"),
                           F.col("c_name").alias("location"))
    return roles.geo_columns(df, df.columns).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lat", "lon", "pair")])


@query("T24", """SELECT "column", hit_rate FROM (SELECT 'mail' AS "column", avg(CAST(regexp_matches(lower(replace(c_name, '#', '')) || '@mail.example.org', '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS DOUBLE)) AS hit_rate FROM customer
UNION ALL SELECT 'c_mktsegment', avg(CAST(regexp_matches(c_mktsegment, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS DOUBLE)) FROM customer) WHERE hit_rate >= 0.5""")
def personal_values(t):
    df = t.customer.select(F.concat(F.lower(F.translate("c_name", "#", "")), F.lit("@mail.example.org")).alias("mail"), "c_mktsegment")
    return roles.sensitive_values(df, df.columns)


@query("T8 SR7", """SELECT 'conversations' AS "table", 'text' AS "column", 1 AS rank FROM conversations HAVING avg(length(text)) > 60 AND avg(CAST(contains(trim(text), ' ') AS INTEGER)) > 0.5""")
def searchable_fields(t):
    return roles.free_text_fields(pf.profile(t.conversations, "conversations"))


@query("T12", "SELECT 'fecha' AS event_time FROM orders HAVING bool_and(o_orderdate IS NOT NULL)")
def event_time_column(t):
    return pf.event_time(pf.profile(_text_orders(t)))


@query("A23 T9", """SELECT 'shop' AS "table", 'dimension' AS use, 'o_orderstatus' AS "column", 1 AS rank UNION ALL SELECT 'shop', 'dimension', 'o_orderpriority', 2 UNION ALL SELECT 'shop', 'measure', 'o_totalprice', 1""")
def proposed_rollup(t):
    return roles.rollup_plan(pf.profile(t.orders.select("o_orderstatus", "o_orderpriority", "o_totalprice", F.col("o_orderkey").cast("string").alias("order_id")), "shop"))
