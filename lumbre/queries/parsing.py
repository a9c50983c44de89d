"""Lines of every supported format, made from the driver tables, parsed, and compared with the columns they came from."""

from functools import reduce

from pyspark.sql import functions as F

from lumbre.functions import dates, missing, nested, net, numbers
from lumbre.functions.dates import iso
from lumbre.functions.keys import composite_key, fingerprint, in_share, masked, prune, row_uuid
from lumbre.operators import derived, scan
from lumbre.plans import delimited, fix, formats, grok, keyvalue
from lumbre.queries.registry import query
from lumbre.session import scratch_path
from lumbre.sources import readers, sinks

FMT = "'%Y-%m-%d %H:%M:%S'"


def text(c):
    return F.col(c).cast("string")


@query("P5 R2", "SELECT event_id, user_id, event_type, value FROM events")
def kv_line_roundtrip(t):
    e = t.spread("events")
    lines = e.select(F.concat(F.lit("event_id="), text("event_id"), F.lit(' user_id="'), text("user_id"), F.lit('" event_type='),
                              F.col("event_type"), F.lit(" value="), text("value")).alias("value"))
    m = keyvalue.parse_lines(lines)
    get = lambda k: F.try_element_at("pairs", F.lit(k))
    return m.select(get("event_id").try_cast("bigint").alias("event_id"), get("user_id").try_cast("bigint").alias("user_id"),
                    get("event_type").alias("event_type"), get("value").try_cast("double").alias("value"))


@query("P7 P8 P5", "SELECT event_id, event_type AS carrier, user_id AS version FROM events")
def nested_kv_roundtrip(t):
    lines = t.spread("events").select(F.concat(F.lit("2024-01-01 - id="), text("event_id"), F.lit("|kind=x|detail=carrier="), F.col("event_type"),
                                     F.lit("~version="), text("user_id")).alias("value"))
    df = keyvalue.parse_lines(lines, "|", ["day", None], nested={"detail": "~"})
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    return df.select(get("pairs", "id").try_cast("bigint").alias("event_id"), get("detail", "carrier").alias("carrier"),
                     get("detail", "version").try_cast("bigint").alias("version"))


@query("P6 P7 F9", "SELECT count(*) AS lines, count(*) AS kv_lines, '|' AS separator, 2 AS envelope, true AS is_kv FROM events")
def kv_detection(t):
    lines = t.spread("events").select(F.concat(F.lit("2024-01-01 - id="), text("event_id"), F.lit("|kind=x|type="), F.col("event_type")).alias("value"))
    return keyvalue.detect(lines)


@query("P11 P14", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_line_roundtrip(t):
    lines = t.orders.select(F.concat_ws(";", text("o_orderkey"), F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"')), text("o_totalprice"),
                                        F.col("o_orderpriority"), F.lit("")).alias("value"))
    header = lines.sparkSession.createDataFrame([("key;status;price;priority;note",)], "value string")
    rows = delimited.drop_header(header.unionByName(lines), "key;status;price;priority;note")
    df = delimited.parse_lines(rows, ["key", "status", "price", "priority", "note"], ";")
    return df.where(F.col("note").isNull()).select(F.col("key").try_cast("bigint").alias("o_orderkey"), F.col("status").alias("o_orderstatus"),
                                                   F.col("price").try_cast("double").alias("o_totalprice"), F.col("priority").alias("o_orderpriority"))


@query("P12", """WITH l AS (SELECT regexp_replace(concat_ws(';', o_orderkey, o_orderstatus, o_totalprice, '"a;b,' || o_orderpriority || '"'), '"[^"]*"', '', 'g') AS v FROM orders),
c AS (SELECT sep, place, len(v) - len(replace(v, sep, '')) + 1 AS columns, count(*) AS n FROM l, (VALUES (',', 0), (';', 1), ('|', 2), (chr(9), 3)) AS s(sep, place) GROUP BY ALL)
SELECT sep AS separator, CAST(columns AS INTEGER) AS columns FROM c WHERE columns >= 2 AND n >= floor((SELECT count(*) FROM orders) * 0.9) ORDER BY columns DESC, place LIMIT 1""")
def delimiter_choice(t):
    lines = t.spread("orders").select(F.concat_ws(";", text("o_orderkey"), F.col("o_orderstatus"), text("o_totalprice"),
                                        F.concat(F.lit('"a;b,'), F.col("o_orderpriority"), F.lit('"'))).alias("value"))
    return delimited.choose_separator(lines)


@query("P13", """SELECT bool_and(TRY_CAST(CAST(o_orderkey AS VARCHAR) AS DOUBLE) IS NOT NULL) OR bool_and(TRY_CAST(o_orderstatus AS DOUBLE) IS NOT NULL) OR NOT bool_or(o_orderstatus = 'Status') AS is_header FROM orders""")
def header_detection(t):
    lines = t.spread("orders").select(F.concat_ws(",", text("o_orderkey"), F.col("o_orderstatus"), text("o_totalprice")).alias("value"))
    return delimited.looks_like_header(lines, "Order key,Status,Total", ",")


@query("P2 P4 R1", f"""SELECT event_id, user_id, event_type, strftime(ts, {FMT}) AS at FROM events""")
def grok_line_roundtrip(t):
    lines = t.spread("events").select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.col("event_type"), F.lit("] user "),
                                     text("user_id"), F.lit(" did event #"), text("event_id"), F.lit(" from 10.0.0.1")).alias("value"))
    g = grok.grok(F.col("value"), r"^%{TIMESTAMP_ISO8601:at} \[%{WORD:kind}\] user %{INT:user} did event #%{INT:id} from %{IP:ip}$")
    df = lines.select(g.alias("g")).where(F.col("g.ip") == "10.0.0.1")
    return df.select(F.col("g.id").cast("bigint").alias("event_id"), F.col("g.user").cast("bigint").alias("user_id"),
                     F.col("g.kind").alias("event_type"), F.col("g.at").alias("at"))


@query("P4", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def dissect_roundtrip(t):
    lines = t.customer.select(F.concat(text("c_custkey"), F.lit(" - "), F.col("c_name"), F.lit(" ("), F.col("c_mktsegment"), F.lit(")")).alias("value"))
    d = grok.dissect(F.col("value"), "%{key} - %{name} (%{segment})")
    return lines.select(d.alias("d")).select(F.col("d.key").cast("bigint").alias("c_custkey"), F.col("d.name").alias("c_name"),
                                             F.col("d.segment").alias("c_mktsegment"))


@query("P15", f"SELECT user_id, event_type, CAST(200 + event_id % 5 AS BIGINT) AS status, event_id AS bytes, strftime(ts, {FMT}) AS at FROM events")
def apache_common_roundtrip(t):
    lines = t.spread("events").select(F.concat(F.lit("10.1.2.3 - u"), text("user_id"), F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
                                     F.lit(' +0000] "GET /'), F.col("event_type"), F.lit(' HTTP/1.1" '), (200 + F.col("event_id") % 5).cast("string"),
                                     F.lit(" "), text("event_id")).alias("value"))
    df = formats.parse_lines(lines, "apache_common")
    return df.select(F.substring(F.col("user.name"), 2, 20).cast("bigint").alias("user_id"), F.substring("url.original", 2, 50).alias("event_type"),
                     F.col("http.response.status_code").alias("status"), F.col("http.response.body.bytes").alias("bytes"), iso(F.col("@timestamp")).alias("at"))


@query("P16 E8", """SELECT CASE WHEN event_id % 2 = 0 THEN 'Firefox' ELSE 'Chrome' END AS browser, CASE WHEN event_id % 2 = 0 THEN 'Linux' ELSE 'Windows' END AS system,
count(*) AS n FROM events GROUP BY 1, 2""")
def apache_combined_agents(t):
    agent = F.when(F.col("event_id") % 2 == 0, F.lit("Mozilla/5.0 (X11; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/115.0")) \
        .otherwise(F.lit("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36"))
    lines = t.spread("events").select(F.concat(F.lit('10.1.2.3 - - [01/Jan/2024:10:00:00 +0000] "GET /a HTTP/1.1" 200 12 "http://x/" "'), agent, F.lit('"')).alias("value"))
    df = formats.parse_lines(lines, "apache_combined")
    return df.groupBy(net.browser(F.col("user_agent.original")).alias("browser"), net.system(F.col("user_agent.original")).alias("system")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("P17 E18", f"""SELECT event_id AS pid, event_type AS app, strftime(ts, {FMT}) AS at, CAST((event_id % 190 + 1) // 8 AS BIGINT) AS facility,
CAST((event_id % 190 + 1) % 8 AS BIGINT) AS severity FROM events""")
def syslog_5424_roundtrip(t):
    lines = t.spread("events").select(F.concat(F.lit("<"), (F.col("event_id") % 190 + 1).cast("string"), F.lit(">1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
                                     F.lit("Z web-01 "), F.col("event_type"), F.lit(" "), text("event_id"), F.lit(" ID1 something happened")).alias("value"))
    df = formats.parse_lines(lines, "syslog_5424")
    return df.select(F.col("process.pid").cast("bigint").alias("pid"), F.col("process.name").alias("app"), iso(F.col("@timestamp")).alias("at"),
                     F.col("log.syslog.facility.code").alias("facility"), F.col("log.syslog.severity.code").alias("severity"))


@query("P18", f"""SELECT event_id + 1 AS pid, event_type AS app, 'value ' || CAST(user_id AS VARCHAR) AS msg, strftime(ts, {FMT}) AS at FROM events""")
def syslog_3164_roundtrip(t):
    lines = t.spread("events").select(F.concat(F.lit("<34>"), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host1 "), F.col("event_type"), F.lit("["), (F.col("event_id") + 1).cast("string"),
                                     F.lit("]: value "), text("user_id")).alias("value"))
    df = formats.parse_lines(lines, "syslog_3164", year=2024)
    return df.select(F.col("process.pid").cast("bigint").alias("pid"), F.col("process.name").alias("app"), F.col("message").alias("msg"), iso(F.col("@timestamp")).alias("at"))


@query("P19", f"""SELECT event_id + 1 AS pid, event_type AS app, 'value ' || CAST(user_id AS VARCHAR) AS msg, strftime(ts, {FMT}) AS at FROM events""")
def syslog_iso_roundtrip(t):
    lines = t.spread("events").select(F.concat(F.lit("<134>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" bastion-01 "), F.col("event_type"), F.lit("["),
                                     (F.col("event_id") + 1).cast("string"), F.lit("]: value "), text("user_id")).alias("value"))
    df = formats.parse_lines(lines, "syslog_iso")
    return df.select(F.col("process.pid").cast("bigint").alias("pid"), F.col("process.name").alias("app"), F.col("message").alias("msg"), iso(F.col("@timestamp")).alias("at"))


@query("P31 P19 R13", """SELECT CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'signup' THEN 'success' ELSE '' END AS outcome,
CASE WHEN event_type IN ('error', 'signup') THEN 'ssh_login' WHEN event_type = 'purchase' THEN 'sudo' ELSE '' END AS action,
CASE WHEN event_type IN ('error', 'signup') THEN 'user' || CAST(user_id AS VARCHAR) ELSE '' END AS user_name, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def ssh_messages(t):
    kind = F.col("event_type")
    user, addr = F.concat(F.lit("user"), text("user_id")), F.lit(" from 10.0.0.7 port 22 ssh2 technique=T1110 campaign=CMP-001")
    msg = F.when(kind == "error", F.concat(F.lit("Failed password for invalid user "), user, addr)) \
        .when(kind == "signup", F.concat(F.lit("Accepted password for "), user, addr)).otherwise(F.lit("session opened technique=T1003"))
    program = F.when(kind == "purchase", F.lit("sudo")).otherwise(F.lit("sshd"))
    lines = t.spread("events").select(F.concat(F.lit("<134>2024-01-02T03:04:05Z bastion-01 "), program, F.lit("[12]: "), msg).alias("value"))
    df = formats.parse_lines(lines, "syslog_iso")
    out = df.select(*nested.nest(formats.ssh_fields(F.col("message"), F.col("process.name"))))
    return out.groupBy(F.coalesce("event.outcome", F.lit("")).alias("outcome"), F.coalesce("event.action", F.lit("")).alias("action"),
                       F.coalesce("user.name", F.lit("")).alias("user_name")).agg(F.count(F.lit(1)).alias("n"))


@query("P20", "SELECT event_id, 'user ' || CAST(user_id AS VARCHAR) AS suser, event_type AS act, CAST(event_id % 65536 AS BIGINT) AS spt, CAST(event_id % 10 AS BIGINT) AS severity FROM events")
def cef_roundtrip(t):
    lines = t.spread("events").select(F.concat(F.lit("CEF:0|Acme|Guard|1.0|"), text("event_id"), F.lit("|name|"), (F.col("event_id") % 10).cast("string"),
                                     F.lit("|src=10.0.0.1 suser=user "), text("user_id"), F.lit(" act="), F.col("event_type"), F.lit(" spt="),
                                     (F.col("event_id") % 65536).cast("string")).alias("value"))
    df = formats.parse_lines(lines, "cef")
    return df.select(F.col("event.code").cast("bigint").alias("event_id"), F.col("source.user.name").alias("suser"), F.col("event.action").alias("act"),
                     F.col("source.port").alias("spt"), F.col("event.severity").alias("severity"))


@query("P21", f"""SELECT CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, CASE event_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'pool-1' ELSE '' END AS thread,
strftime(min(ts), {FMT}) AS first_at, count(*) AS n FROM events GROUP BY 1, 2""")
def log4j_alternatives(t):
    e = t.spread("events")
    ts, level = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO"))
    body = F.when(F.col("event_id") % 3 == 0, F.lit(" - [main] Client.run(): done")).when(F.col("event_id") % 3 == 1, F.lit(" [pool-1] com.x.Bar - doing")) \
        .otherwise(F.lit(" plain message"))
    df = formats.parse_lines(e.select(F.concat(F.lit("["), ts, F.lit("] "), level, body).alias("value")), "log4j")
    return df.groupBy(F.col("log.level").alias("level"), F.coalesce("process.thread.name", F.lit("")).alias("thread")) \
        .agg(iso(F.min("@timestamp")).alias("first_at"), F.count(F.lit(1)).alias("n"))


@query("P23 P24", """SELECT format, n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'cef' WHEN 1 THEN 'log4j' WHEN 2 THEN 'syslog_iso' ELSE 'fix' END AS format, count(*) AS n FROM events GROUP BY 1)""")
def format_dispatch(t):
    n = F.col("event_id") % 4
    line = F.when(n == 0, F.lit("CEF:0|a|b|c|d|e|5|src=1.1.1.1")).when(n == 1, F.lit("[2024-01-01 10:00:00,123] INFO x")) \
        .when(n == 2, F.lit("<13>2024-01-01T00:00:00Z h app: x")).otherwise(F.lit("20240101-10:00:00.000 : 8=FIX.4.4|35=D|"))
    return t.spread("events").select(formats.detect(line).alias("format")).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@query("P1 F8 F9", """SELECT CASE event_type WHEN 'error' THEN 'waf' WHEN 'view' THEN 'cloudaudit' WHEN 'click' THEN 'auth' ELSE 'fortigate' END AS dataset, count(*) AS n FROM events GROUP BY 1""")
def security_source_sniff(t):
    k = F.col("event_type")
    line = F.when(k == "error", F.lit('{"attack":"sqli"}')).when(k == "view", F.lit('{"trace_name":"createX"}')).when(k == "click", F.lit("<13>2024 x")) \
        .otherwise(F.lit("date=2024-01-01 time=00:00:00 type=traffic"))
    return t.events.select(formats.source_of(line).alias("dataset")).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("P25 P26 P28 J10", f"""SELECT l_orderkey || '-' || l_linenumber AS cl_ord_id, CASE l_returnflag WHEN 'R' THEN 'Venta' ELSE 'Compra' END AS side, l_quantity AS qty,
round(l_quantity * l_extendedprice, 2) AS monto, 'entrante' AS direccion, 'MKT' AS contraparte, CAST(l_orderkey % 900 AS BIGINT) AS latencia_ms FROM lineitem""")
def fix_roundtrip(t):
    base = F.lit("2024-01-02 09:00:00.000").cast("timestamp")
    received = F.timestamp_millis(F.unix_millis(base) + F.col("l_orderkey") % 900)
    lines = t.spread("lineitem").select(F.concat(
        F.date_format(received, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" INFO [t1] quickfix.incoming - FIX.4.4:OMS->MKT: 8=FIX.4.4|9=100|35=8|49=MKT|56=OMS|52=20240102-12:00:00.000|11="),
        text("l_orderkey"), F.lit("-"), text("l_linenumber"), F.lit("|54="), F.when(F.col("l_returnflag") == "R", F.lit("2")).otherwise(F.lit("1")),
        F.lit("|54=9|32="), text("l_quantity"), F.lit("|31="), text("l_extendedprice"), F.lit("|10=000|")).alias("value"))
    d = fix.decode(lines, "slf4j")
    return d.select(F.col("fix_cl_ord_id").alias("cl_ord_id"), F.col("fix_side").alias("side"), F.col("fix_last_qty").alias("qty"),
                    F.col("fix_monto_ejecutado").alias("monto"), F.col("fix_direccion").alias("direccion"), F.col("fix_contraparte").alias("contraparte"),
                    F.col("fix_latencia_ms").alias("latencia_ms"))


@query("P27", """SELECT CASE event_type WHEN 'error' THEN 'secuencia_alta' WHEN 'view' THEN 'logon' WHEN 'click' THEN 'desconexion' ELSE 'otro' END AS kind,
CAST(max(CASE WHEN event_type = 'error' THEN event_id % 50 ELSE 0 END) AS BIGINT) AS jump, count(*) AS n FROM events GROUP BY 1""")
def fix_session_events(t):
    k = F.col("event_type")
    msg = F.when(k == "error", F.concat(F.lit("MsgSeqNum too high, expecting 100 but received "), (100 + F.col("event_id") % 50).cast("string"))) \
        .when(k == "view", F.lit("Received logon")).when(k == "click", F.lit("Disconnecting: socket closed")).otherwise(F.lit("checking"))
    lines = t.spread("events").select(F.concat(F.lit("2024-01-02 09:00:00.000 INFO [t] quickfix.event - FIX.4.4:OMS->MKT: "), msg).alias("value"))
    d = fix.decode(lines, "slf4j")
    return d.groupBy(F.col("fix_tipo_evento").alias("kind")).agg(F.coalesce(F.max("fix_salto_secuencia"), F.lit(0)).cast("bigint").alias("jump"), F.count(F.lit(1)).alias("n"))


@query("P9 N12", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json_extract(t):
    return t.events.select("event_id", nested.parse_json(F.col("props"), "k bigint").getField("k").alias("k"))


@query("P9 P10 P30", "SELECT event_id, event_type AS user_name, user_id AS user_id_text, CAST(json_extract(props, '$.k') AS BIGINT) AS first_k FROM events")
def json_flatten_roundtrip(t):
    user = F.to_json(F.struct(F.col("event_type").alias("user_name")))
    doc = F.to_json(F.struct(F.struct(F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("uid")).alias("deep")).alias("a"),
                             F.array(F.from_json("props", "k bigint")).alias("items"), user.alias("user")))
    parsed = t.spread("events").select(F.from_json(doc, "a struct<id:bigint,deep:struct<uid:bigint>>, items array<struct<k:bigint>>, user string").alias("d")).select("d.*")
    flat = nested.flatten(parsed)
    return flat.select(F.col("a_id").alias("event_id"), F.from_json("user", "user_name string")["user_name"].alias("user_name"),
                       F.col("a_deep_uid").alias("user_id_text"), F.col("items_k").alias("first_k"))


@query("P29 D4", "SELECT event_id, event_type FROM events")
def json_array_split(t):
    one = F.to_json(F.struct("event_id", "event_type"))
    per_user = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one)
    rows = readers.split_json_array(t.events.select(per_user.alias("value")))
    return rows.select(F.from_json("value", "event_id bigint, event_type string").alias("r")).select("r.*")


@query("S14 S16", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, md5(text) AS digest FROM documents")
def multiline_roundtrip(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    rec = readers.assemble_records(lines, F.col("pos") == 0, ["doc_id"], "pos", max_lines=1_000_000)
    return rec.select("doc_id", F.col("lines").cast("bigint").alias("lines"), F.md5("value").alias("digest"))


@query("S16", "SELECT true AS multiline, CAST(sum(len(string_split(text, chr(10))) - 1) AS BIGINT) AS continuations FROM "
              "(SELECT text FROM conversations) WHERE true")
def continuation_detection(t):
    lines = t.conversations.select(F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    value = F.when(F.col("pos") == 0, F.concat(F.lit("2024-01-01 "), F.col("line"))).otherwise(F.concat(F.lit("  at "), F.col("line")))
    return readers.has_continuations(lines.select(value.alias("value")))


# kinds of ids and dates that begin a record; what is expected follows from the lengths and shapes of the values themselves
_STARTS = {"hex12": ("substr(md5(o_orderkey::VARCHAR), 1, 12)", lambda k: F.substring(F.md5(k.cast("string")), 1, 12)), "hex16": ("substr(md5(o_orderkey::VARCHAR), 1, 16)", lambda k: F.substring(F.md5(k.cast("string")), 1, 16)),
           "hex24": ("substr(md5(o_orderkey::VARCHAR), 1, 24)", lambda k: F.substring(F.md5(k.cast("string")), 1, 24)), "mixed": ("substr(md5(o_orderkey::VARCHAR), 1, 9 + o_orderkey % 2)", lambda k: F.substring(F.md5(k.cast("string")), F.lit(1), (9 + k % 2).cast("int"))),
           "day": ("strftime(o_orderdate, '%d/%m/%Y')", lambda k: F.date_format("o_orderdate", "dd/MM/yyyy")), "minute": ("strftime(o_orderdate, '%Y-%m-%d %H:%M')", lambda k: F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")),
           "compact": ("strftime(o_orderdate, '%Y%m%d-%H:%M:%S')", lambda k: F.date_format("o_orderdate", "yyyyMMdd-HH:mm:ss")), "code": ("'ORD-' || lpad(o_orderkey::VARCHAR, 9, '0')", lambda k: F.concat(F.lit("ORD-"), F.lpad(k.cast("string"), 9, "0"))),
           "number": ("o_orderkey::VARCHAR", lambda k: k.cast("string")), "in text": ("o_orderkey::VARCHAR || 'x'", lambda k: F.concat(k.cast("string"), F.lit("x")))}
_START_SQL = " UNION ALL ".join(f"SELECT '{kind}' AS kind, {sql} AS v FROM orders" for kind, (sql, _) in _STARTS.items())


@query("S15", rf"""WITH v AS ({_START_SQL}),
s AS (SELECT kind, min(length(v)) AS lo, max(length(v)) AS hi, bool_and(regexp_full_match(v, '[0-9a-fA-F]{{8,}}')) AS hex, bool_and(regexp_full_match(v, '\d+')) AS digits,
  bool_and(regexp_full_match(v, '\d{{2}}/\d{{2}}/\d{{4}}')) AS dmy, bool_and(regexp_full_match(v, '\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}')) AS ymd, bool_and(regexp_full_match(v, '\d{{8}}-\d{{2}}:\d{{2}}:\d{{2}}')) AS compact,
  bool_and(regexp_full_match(v, '[A-Z]{{3}}-\d{{9}}')) AS code FROM v GROUP BY 1)
SELECT kind, '^"?' || CASE WHEN hex AND lo = hi AND NOT digits THEN '[0-9a-fA-F]{{' || lo || '}}' WHEN ymd THEN '\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}' WHEN dmy THEN '\d{{2}}/\d{{2}}/\d{{4}}' WHEN compact THEN '\d{{8}}-\d{{2}}:\d{{2}}:\d{{2}}'
  WHEN code THEN '[A-Z]{{3}}\-\d{{9}}' WHEN digits THEN '\d+' END || '"?,' AS start FROM s""")
def record_start_inference(t):
    rest = F.concat(F.lit(',"'), F.col("o_orderstatus"), F.lit('\nmore, of the same"'))
    found = [readers.record_start(t.orders.select(F.concat(token(F.col("o_orderkey")), rest).alias("value"))).select(F.lit(kind).alias("kind"), "start") for kind, (_, token) in _STARTS.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


@query("S6", "SELECT CAST(least(200, greatest(count(*) - 1, 0)) AS BIGINT) AS n, CAST(least(200, greatest(count(*) - 1, 0)) AS BIGINT) AS ordered FROM orders")
def sampled_lines(t):
    # one file, of which the last line is cut
    path = scratch_path(t.spark, "sample")
    rows = t.orders.orderBy("o_orderkey").select(F.format_string("%012d;%s", "o_orderkey", "o_orderstatus").alias("value"))
    rows.coalesce(1).write.text(path)
    sample = readers.sample_lines(readers.read_lines(t.spark, path, metadata=True), 200, cut=True)
    from pyspark.sql import Window
    after = F.lag("value").over(Window.partitionBy("file").orderBy("line_no"))
    return sample.withColumn("before", after).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before").isNull() | (F.col("before") < F.col("value"))).alias("ordered"))


@query("S1 S5 S11 S12", f"""SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1""")
def text_source_roundtrip(t):
    path = scratch_path(t.spark, "lines")
    e = t.events
    e.select(F.concat(F.lit("﻿ "), F.col("event_type"), F.lit(" "), text("event_id"), F.lit("\r")).alias("value")) \
        .unionByName(e.select(F.lit("# comment").alias("value"))).write.option("compression", "gzip").text(path)
    lines = readers.read_lines(t.spark, path)
    p = F.split("value", " ")
    return lines.select(p[0].alias("event_type"), p[1].cast("bigint").alias("id")).groupBy("event_type") \
        .agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("S8 S9 S13 U1", """SELECT c_mktsegment AS segment, count(*) * 2 AS n, round(sum(c_acctbal) * 2, 2) AS balance FROM customer GROUP BY 1""")
def csv_and_json_sources(t):
    c = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    csv_path, json_path = scratch_path(t.spark, "csv"), scratch_path(t.spark, "json")
    c.write.option("sep", ";").option("quoteAll", "true").option("header", "true").csv(csv_path)
    c.withColumn("extra", F.lit("x")).write.option("compression", "gzip").json(json_path)
    a = readers.read_csv(t.spark, csv_path, "c_custkey bigint, c_mktsegment string, c_acctbal double", ";", header=True).where("_corrupt_record IS NULL")
    b = readers.read_json_lines(t.spark, json_path, "c_custkey bigint, c_mktsegment string, c_acctbal double, extra string")
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("S7", """WITH b AS (SELECT min(event_id) AS lo, greatest((max(event_id) - min(event_id) + 1) / 50.0, 1e-9) AS width FROM events)
SELECT e.* FROM events e, b QUALIFY event_id = min(event_id) OVER (PARTITION BY floor((event_id - lo) / width))""")
def spread_sample_events(t):
    return readers.spread_sample(t.events, "event_id", 50)


@query("S3", "SELECT event_type AS host, count(*) AS n FROM events GROUP BY 1")
def beats_events(t):
    doc = F.to_json(F.struct(F.lit("line").alias("message"), F.struct(F.col("event_type").alias("name")).alias("host"),
                             F.struct(F.struct(F.lit("/var/log/a").alias("path")).alias("file")).alias("log")))
    f = readers.beats_fields(F.col("value"))
    return t.events.select(doc.alias("value")).select(*[c.alias(n) for n, c in f.items()]).where(F.col("value") == "line") \
        .groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("K1 R18 U2 N17", """SELECT strftime(o_orderdate, '%Y_%m') AS month, count(*) AS n FROM orders WHERE o_orderdate >= '1996-11-01' AND o_orderdate < '1997-03-01' GROUP BY 1""")
def monthly_table_pruned(t):
    path = scratch_path(t.spark, "months")
    sinks.write_monthly(t.orders, path, "o_orderdate")
    months = t.spark.range(1).select(dates.months_between("1996-11", "1997-02").alias("m")).first()["m"]
    return sinks.read_months(t.spark, path, months).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("R18", "SELECT strftime(o_orderdate, '%Y_%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def monthly_partition_counts(t):
    return t.orders.groupBy(dates.month_key(F.col("o_orderdate")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("K5", "SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n FROM orders GROUP BY 1")
def reload_does_not_duplicate(t):
    path = scratch_path(t.spark, "reload")
    for _ in range(2):
        sinks.reload_months(t.orders, path, "o_orderdate")
    return t.spark.read.parquet(path).groupBy(F.date_format("o_orderdate", "yyyy").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("K6 F11", """SELECT CASE WHEN event_type = 'error' THEN 'bad' ELSE 'good' END AS side, count(*) AS n FROM events GROUP BY 1""")
def quarantine_split(t):
    line = F.when(F.col("event_type") == "error", F.lit("garbage")).otherwise(F.lit("<34>Jan 02 03:04:05 host1 app[1]: x"))
    df = formats.parse_lines(t.events.select("event_id", line.alias("value")), "syslog_3164", year=2024)
    good, bad = sinks.split_quarantine(df)
    return good.select(F.lit("good").alias("side")).unionByName(bad.select(F.lit("bad").alias("side"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("K2 U1 N7 A35", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def dedup_by_fingerprint(t):
    twice = t.events.unionByName(t.events)
    once = sinks.distinct_by_id(sinks.with_document_id(twice, ["event_id", "user_id", "event_type"]), "document_id")
    return once.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("K2", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def overwrite_by_id(t):
    return sinks.latest_by_id(t.events, "user_id", "event_id").select("user_id", "event_id")


@query("T7 R6 R2 N14", "SELECT c_custkey, round(c_acctbal, 2) AS balance, round(c_acctbal, 2) AS again FROM customer")
def number_cleaning(t):
    point = F.concat(F.lit("$ "), F.format_number("c_acctbal", 2))
    comma = F.translate(F.format_number("c_acctbal", 2), ",.", ".,")
    df = t.customer.select("c_custkey", point.alias("p"), F.concat(comma, F.lit(" %")).alias("c"))
    return df.select("c_custkey", F.round(numbers.strip_marks(F.col("p")), 2).alias("balance"), F.round(numbers.parse(F.col("c"), ","), 2).alias("again"))


@query("T5 N8 N9", f"""SELECT event_id, strftime(ts - INTERVAL 3 HOUR, {FMT}) AS local, strftime(date_trunc('second', ts), {FMT}) AS utc FROM events""")
def zones_and_epochs(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    utc = dates.parse(ms, "UNIX_MS")
    local = dates.to_user_zone(utc, dates.DEFAULT_ZONE)
    back = dates.parse(F.date_format(local, "yyyyMMddHHmmssSSS"), "yyyyMMddHHmmssSSS", dates.DEFAULT_ZONE)
    return t.events.select("event_id", iso(local).alias("local"), iso(back).alias("utc"))


@query("T12 R3", f"SELECT o_orderkey, strftime(o_orderdate, {FMT}) AS at FROM orders")
def date_and_time_merged(t):
    df = t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"), F.lit("0:00:00").alias("h"))
    return df.select("o_orderkey", iso(dates.merge_date_time(F.col("d"), F.col("h"), "dd/MM/yyyy")).alias("at"))


@query("R7 R8 N2", """SELECT CAST(count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) AS BIGINT) AS filled, CAST(count(*) FILTER (WHERE event_type IN ('view', 'click')) AS BIGINT) AS empty,
round(sum(CASE WHEN event_type = 'error' THEN 0 ELSE value END), 2) AS total FROM events""")
def missing_values_cleaned(t):
    k = F.col("event_type")
    raw = t.events.select(F.when(k == "view", F.lit(" N/A ")).when(k == "click", F.lit("-")).otherwise(k).alias("a"),
                          F.struct(F.when(k == "error", F.lit(None)).otherwise(F.col("value")).alias("v"), F.lit("null").alias("w")).alias("s"))
    c = missing.clean_frame(raw).select("a", F.col("s.v").alias("v"))
    c = missing.zero_if_missing(c, "v")
    return c.agg(F.count("a").alias("filled"), F.count_if(F.col("a").isNull()).alias("empty"), F.round(F.sum("v"), 2).alias("total"))


@query("R9 R4 R5", "SELECT event_id, event_type, 'raw' AS event_type_original, value FROM events")
def promoted_fields(t):
    df = t.events.select("event_type", F.struct("event_id", F.lit("raw").alias("event_type"), "value").alias("data"))
    return nested.promote(df, "data").select("event_id", "event_type", "event_type_original", "value")


@query("R10", "SELECT user_id || ':' || event_id AS operation_key FROM events")
def composite_keys(t):
    return t.events.select(composite_key(F.col("user_id"), F.col("event_id")).alias("operation_key"))


@query("R11", """SELECT CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN o_orderstatus END AS o_orderstatus_falla,
CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS o_orderpriority_falla, count(*) AS n FROM orders GROUP BY ALL""")
def failure_column(t):
    rows = derived.with_failure(derived.with_failure(t.orders, "o_orderstatus", ok=["O", "F"]), "o_orderpriority", fails=["1-URGENT", "2-HIGH"])
    return rows.groupBy("o_orderstatus_falla", "o_orderpriority_falla").agg(F.count(F.lit(1)).alias("n"))


@query("R12 T23", """SELECT CAST(count(*) FILTER (WHERE c_custkey % 5 NOT IN (0, 1)) AS BIGINT) AS located, count(*) AS n FROM customer""")
def geo_points(t):
    k = F.col("c_custkey") % 5
    pair = F.when(k == 0, F.lit("0,0")).when(k == 1, F.lit("95.1,10")).otherwise(F.lit("-34.9, -57.9"))
    return t.customer.agg(F.count(net.geo_point_from_text(pair)).alias("located"), F.count(F.lit(1)).alias("n"))


@query("R16 N10", "SELECT doc_id, CAST(least(len(string_split(text, ' ')), 4) AS BIGINT) AS kept, string_split(text, ' ')[1] AS head FROM documents")
def slim_items(t):
    items = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("w"), F.length(w).alias("n")))
    return t.documents.select("doc_id", derived.slim_items(items).alias("i")).select("doc_id", F.size("i").cast("bigint").alias("kept"), F.col("i")[0]["w"].alias("head"))


@query("R16 N10", """WITH i AS (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS lines FROM lineitem)
SELECT l_orderkey AS order_id, CAST(any_value(lines) AS BIGINT) AS n_lines, count(*) AS kept, CAST(sum(l_partkey) AS BIGINT) AS parts, sum(CAST(l_quantity AS DOUBLE)) AS quantity FROM i WHERE k <= 4 GROUP BY 1""")
def slim_orders(t):
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    docs = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("lines"), F.max("l_shipdate").alias("shipped"))
    docs = docs.select(F.struct(F.col("l_orderkey").alias("id"), F.struct(F.col("shipped").alias("at"), F.size("lines").cast("bigint").alias("n")).alias("sent")).alias("order"), "lines")
    slim = derived.slim_document(docs, {"order_id": "order.id", "n_lines": "order.sent.n"}, {"products": ("lines", {"part": "l_partkey", "quantity": "l_quantity"})})
    total = lambda leaf, kind: F.aggregate("products", F.lit(0).cast(kind), lambda s, x: s + x[leaf].cast(kind))
    return slim.select("order_id", "n_lines", F.size("products").cast("bigint").alias("kept"), total("part", "bigint").alias("parts"), total("quantity", "double").alias("quantity"))


@query("E18 R5", """SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + ('0x' || substr(h, 17, 1))::INT % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS row_uuid
FROM (SELECT event_id, substr(sha256(event_id || '|' || event_type), 1, 32) AS h FROM events)""")
def uuid_and_prune(t):
    rows = t.events.withColumn("row_uuid", row_uuid(F.col("event_id"), F.col("event_type")))
    return prune(rows, ["^event_", "uuid$"], ["_type$"])


@query("R20", "SELECT sha256(c_mktsegment) AS c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def masking_counts(t):
    return t.customer.groupBy(masked(F.col("c_mktsegment")).alias("c_mktsegment")).agg(F.count(F.lit(1)).alias("n"))


@query("N11 P5", "SELECT event_id, event_type AS kind FROM events WHERE event_type <> 'view'")
def map_edits(t):
    m = F.create_map(F.lit("type"), F.col("event_type"), F.lit("junk"), F.lit("-"))
    m = nested.rename_keys(nested.delete_if(m, lambda k, v: missing.is_missing(v) | (v == "view")), {"type": "kind"})
    return t.events.select("event_id", m.alias("m")).where(F.size("m") > 0).select("event_id", F.element_at("m", "kind").alias("kind"))


@query("E10 E17 R6", "SELECT page_id, upper(split_part(url, '/', 3)) AS host, substr(url, 1, 12) AS head FROM pages")
def string_edits(t):
    encoded = F.url_decode(F.url_encode("url"))
    return t.pages.select("page_id", F.upper(F.get(F.split(encoded, "/"), 2)).alias("host"), F.substring(encoded, 1, 12).alias("head"))


@query("E17", "SELECT CAST(page_id AS VARCHAR) AS id, url FROM pages")
def xml_fields(t):
    x = F.concat(F.lit("<p><id>"), text("page_id"), F.lit("</id><u>"), F.regexp_replace("url", "&", "&amp;"), F.lit("</u></p>"))
    return t.pages.select(F.from_xml(x, F.lit("id string, u string")).alias("x")).select(F.col("x.id").alias("id"), F.col("x.u").alias("url"))


@query("E18", "SELECT event_id, unnest(['original', 'copy']) AS clone, CASE WHEN value BETWEEN 0 AND 50 THEN 'low' ELSE 'high' END AS band FROM events")
def cloned_and_banded(t):
    band = F.when(F.col("value").between(0, 50), F.lit("low")).otherwise(F.lit("high"))
    return t.events.select("event_id", F.explode(F.array(F.lit("original"), F.lit("copy"))).alias("clone"), band.alias("band"))


@query("P22", """SELECT count(*) FILTER (WHERE abs(len(v) - len(replace(v, ',', '')) - 3) <= 2) >= greatest(1, floor(count(*) / 2)) AS is_csv
FROM (SELECT concat_ws(',', o_orderkey, o_orderstatus, o_totalprice, o_orderpriority) AS v FROM orders)""")
def csv_heuristic(t):
    lines = t.orders.select(F.concat_ws(",", text("o_orderkey"), F.col("o_orderstatus"), text("o_totalprice"), F.col("o_orderpriority")).alias("value"))
    return formats.looks_like_csv(lines, "key,status,total,priority")


@query("N7", "SELECT event_id, sha256(CAST(event_id AS VARCHAR) || '|' || event_type) AS id FROM events")
def fingerprints(t):
    return t.events.select("event_id", fingerprint(F.col("event_id"), F.col("event_type")).alias("id"))


@query("E9", "SELECT * FROM events WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS UBIGINT) < 0.3 * 4294967296")
def thinned_events(t):
    return t.events.where(in_share(0.3, F.col("event_id")))


@query("S14", """SELECT o_orderstatus AS status, count(*) AS lines, md5(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey)) AS body, 0 AS errors FROM orders GROUP BY 1""")
def long_quoted_records(t):
    """One record per order status whose quoted cell has a line for each order."""
    # numbered by slices of the keys, so that no status has to fit in one task
    ones = t.orders.select("o_orderstatus", "o_orderkey", F.lit(1).alias("one"))
    numbered = scan.chunked_scan(ones, ["o_orderstatus"], "o_orderkey", F.floor(F.col("o_orderkey") / 100_000), n=("sum", "one"))
    numbered = numbered.join(ones.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("all")), "o_orderstatus")
    line = F.concat(F.when(F.col("n") == 1, F.concat(F.col("o_orderstatus"), F.lit(',"'))).otherwise(""), text("o_orderkey"), F.when(F.col("n") == F.col("all"), '"').otherwise(""))
    records = readers.quoted_records(numbered.select(F.col("o_orderstatus").alias("file"), F.floor((F.col("n") - 1) / 100_000).alias("block"), "n", line.alias("value")), ["file", "block"], "n")
    return records.select(F.substring_index("value", ",", 1).alias("status"), F.col("lines").cast("bigint").alias("lines"),
                          F.md5(F.regexp_extract("value", r'"([^"]*)"', 1)).alias("body"), F.size("parse_errors").alias("errors"))


@query("S12 P25", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def latin1_fix_file(t):
    """A Latin-1 file of FIX messages, whose fields end with a control character, read back whole."""
    path = scratch_path(t.spark, "latin1")
    soh = F.lit("\u0001")
    line = F.concat(F.lit("2024-01-01 caf\u00e9 8=FIX.4.4"), soh, F.lit("35=D"), soh, F.lit("11="), text("event_id"), soh, F.lit("58="), F.col("event_type"), soh)
    t.events.select(line.alias("value")).write.option("encoding", "ISO-8859-1").option("sep", "\u0002").option("quote", "\u0000").option("emptyValue", "").csv(path)
    lines = readers.read_lines(t.spark, path, "ISO-8859-1").where(F.col("value").contains("caf\u00e9"))
    tags = fix.tag_map(F.col("value"))
    return lines.select(F.element_at(tags, "58").alias("event_type"), F.element_at(tags, "11").cast("bigint").alias("id")) \
        .groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("P20", "SELECT event_type, count(*) AS n, count(*) AS others FROM events GROUP BY 1")
def cef_other_keys(t):
    """Extension keys without a standard name stay."""
    line = F.concat(F.lit("CEF:0|v|p|1|9|n|5|src=10.0.0.1 cs3="), F.col("event_type"), F.lit(" dvc=fw "), F.lit("msg=a b"))
    other = formats.parse_lines(t.events.select(line.alias("value")), "cef").select("extension_other")
    return other.groupBy(F.col("extension_other")["cs3"].alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("extension_other")["dvc"] == "fw").alias("others"))


@query("P11 K6", "SELECT event_id, CAST(event_id AS VARCHAR) || ',' || event_type || ',surplus' AS raw_line FROM events WHERE event_id % 5 = 0")
def surplus_cells_flagged(t):
    line = F.concat_ws(",", text("event_id"), "event_type", F.when(F.col("event_id") % 5 == 0, F.lit("surplus")))
    rows = delimited.parse_lines(t.events.select(line.alias("value")), ["id", "kind"])
    return sinks.split_quarantine(rows)[1].select(F.col("id").cast("bigint").alias("event_id"), "raw_line")


@query("K6 P19", "SELECT event_id, 'broken ' || event_type AS raw_line FROM events WHERE event_type = 'error'")
def quarantine_replays(t):
    """Lines that fail keep their text, so the quarantine can be parsed again."""
    good = F.concat(F.lit("<13>2024-01-01T00:00:00Z host app[1]: "), F.col("event_type"))
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("broken "), F.col("event_type"))).otherwise(good)
    rows = formats.parse_lines(t.events.select("event_id", line.alias("value")), "syslog_iso")
    return sinks.split_quarantine(rows)[1].select("event_id", "raw_line")


@query("E20", """SELECT event_id AS octets, '10.0.' || ((user_id // 256) % 256) || '.' || (user_id % 256) AS source, CAST(event_id % 65536 AS BIGINT) AS source_port, CAST(6 AS BIGINT) AS protocol, true AS whole FROM events""")
def netflow_roundtrip(t):
    hexed = lambda c, n: F.lpad(F.hex(c.cast("bigint")), 2 * n, "0")
    fixed = lambda n: F.lit("00" * n)
    user = F.concat(F.lit("0A00"), hexed(F.floor(F.col("user_id") / 256) % 256, 1), hexed(F.col("user_id") % 256, 1))
    flow = F.concat(user, fixed(4 + 4 + 2 + 2 + 4), hexed(F.col("event_id"), 4), fixed(4 + 4), hexed(F.col("event_id") % 65536, 2), fixed(2 + 1 + 1), F.lit("06"), fixed(1 + 2 + 2 + 1 + 1 + 2))
    packets = t.events.select(F.floor(F.col("event_id") / 3).alias("packet"), flow.alias("flow")).groupBy("packet").agg(F.collect_list("flow").alias("flows"))
    header = F.concat(F.lit("0005"), hexed(F.size("flows"), 2), fixed(4 + 4 + 4), hexed(F.col("packet"), 4), fixed(1 + 1 + 2))
    payloads = packets.select(F.unhex(F.concat(header, F.array_join("flows", ""))).alias("value"))
    return readers.flow_records(payloads).select("octets", "source", "source_port", "protocol", F.col("packet.whole").alias("whole"))


@query("E20", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def bulk_roundtrip(t):
    o = t.orders.withColumn("n", F.col("o_orderkey"))
    action = F.to_json(F.struct(F.struct(F.col("o_orderkey").cast("string").alias("_id")).alias("index")))
    lines = o.select(F.explode(F.array(F.struct((F.col("n") * 2).alias("line"), action.alias("value")), F.struct((F.col("n") * 2 + 1).alias("line"), F.to_json(F.struct("o_orderstatus", "o_totalprice")).alias("value")))).alias("l")).select("l.*")
    pairs = readers.bulk_actions(lines, "line")
    doc = F.from_json("document", "o_orderstatus string, o_totalprice double")
    return pairs.select(F.get_json_object("action", "$.index._id").cast("bigint").alias("o_orderkey"), doc["o_orderstatus"].alias("o_orderstatus"), doc["o_totalprice"].alias("o_totalprice"))


@query("E20 P29", "SELECT event_id, event_type FROM events")
def cloud_trail_roundtrip(t):
    files = t.events.groupBy(F.pmod("event_id", F.lit(50)).alias("file")).agg(F.to_json(F.struct(F.collect_list(F.struct("event_id", "event_type")).alias("Records"))).alias("value"))
    rows = readers.cloud_trail_records(files.select("value"))
    return rows.select(F.from_json("value", "event_id bigint, event_type string").alias("r")).select("r.*")


@query("K3 E5", "SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY ALL")
def archived_events(t):
    path = scratch_path(t.spark, "archive")
    sinks.write_archive(t.events.select("event_id", "event_type", "ts"), path, "ts")
    back = t.spark.read.schema("event_id bigint, event_type string, ts string, year string, month string, day string").json(f"{path}/transactions")
    return back.groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
