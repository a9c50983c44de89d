from pyspark.sql import functions as F

from lumbre.functions import dates, missing, nested, net, numbers, text
from lumbre.plans import delimited, fix, formats, grok, keyvalue
from tests.conftest import one


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_missing_texts_are_null_and_empty_structs_go(spark):
    df = spark.createDataFrame([(" N/A ", ("-", "x"), 1), ("ok", ("none", "s/d"), 2)], "a string, s struct<p:string,q:string>, n int")
    rows = missing.clean_frame(df).collect()
    assert rows[0]["a"] is None and rows[0]["s"]["p"] is None and rows[0]["s"]["q"] == "x"
    assert rows[1]["a"] == "ok" and rows[1]["s"] is None


def test_grok_first_alternative_wins_and_optional_captures_are_null(lines):
    df = lines("a=1 b", "x 22", "nothing")
    g = grok.grok(F.col("value"), [r"a=%{INT:n} %{WORD:w}", r"^x %{NUMBER:n}"])
    rows = df.select(g.alias("g")).collect()
    assert (rows[0]["g"]["n"], rows[0]["g"]["w"]) == ("1", "b")
    assert (rows[1]["g"]["n"], rows[1]["g"]["w"]) == ("22", None)
    assert rows[2]["g"] is None


def test_every_core_pattern_compiles_in_java(spark):
    df = spark.range(1).select(F.lit("x").alias("value"))
    for name in grok.CORE:
        regex, _ = grok.expand("%{" + name + "}")
        df.select(F.col("value").rlike(regex)).collect()


def test_pairs_quoted_repeated_and_nested(lines):
    df = lines('date=2026-04-13 srcip=10.1.1.1 msg="two words" a=1 a=2')
    m = one(df.select(keyvalue.pairs(F.col("value")).alias("m")))["m"]
    assert m == {"date": "2026-04-13", "srcip": "10.1.1.1", "msg": "two words", "a": "2"}
    row = one(keyvalue.parse_lines(lines('20251113 - 7846 code=T|steps={"a": "b c"}|detail=os=10~geo_lat=-34.9'), "|", ["at", None, "thread"], nested={"detail": "~"}))
    assert row["at"] == "20251113" and row["thread"] == "7846"
    assert row["pairs"] == {"code": "T", "steps": '{"a": "b c"}'} and row["detail"] == {"os": "10", "geo_lat": "-34.9"}


def test_kv_detection_ignores_log_lines_with_pairs(lines):
    yes = one(keyvalue.detect(lines(*["2026-01-01 M a=1 b=2 c=3"] * 9, "junk")))
    assert yes["is_kv"] and yes["envelope"] == 2 and yes["separator"] == " "
    no = one(keyvalue.detect(lines(*["2026-09-18 11:04:12 INFO did a=1 b=2 c=3"] * 10)))
    assert not no["is_kv"]
    assert one(keyvalue.nested_separator(lines("a=1;b=2", "c=3;d=4"), "value"))["separator"] == ";"
    assert one(keyvalue.nested_separator(lines("a=1;b=2", "plain"), "value"))["separator"] is None
    lits = {r["position"]: r["literal"] for r in keyvalue.fixed_literals(lines("t1 - x a=1", "t2 - y a=2"), 3).collect()}
    assert lits == {0: None, 1: "-", 2: None}


def test_delimited_cells_separator_and_header(lines):
    assert values(lines('a;"b;c";"d""e";'), delimited.cells(F.col("value"), ";")) == [["a", "b;c", 'd"e', ""]]
    df = lines("id;name", '1;"x,y"', "2;z", "3;w")
    assert one(delimited.choose_separator(df))["separator"] == ";"
    assert one(delimited.looks_like_header(df, "id;name", ";"))["is_header"]
    assert not one(delimited.looks_like_header(lines("1,2", "3,4"), "1,2"))["is_header"]
    assert delimited.choose_separator(lines("just words here", "and, more words", "a, b, c, d")).count() == 0
    rows = delimited.parse_lines(delimited.drop_header(df, "id;name"), ["id", "name"], ";").collect()
    assert sorted((r["id"], r["name"]) for r in rows) == [("1", "x,y"), ("2", "z"), ("3", "w")]


def test_formats(lines):
    apache = one(formats.parse_lines(lines('10.0.0.1 - bob [10/Oct/2026:13:55:36 -0300] "GET /a?x=1 HTTP/1.1" 200 512 "http://r/" "Mozilla/5.0"'), "apache_combined"))
    assert apache["source"]["ip"] == "10.0.0.1" and apache["user"]["name"] == "bob" and apache["http"]["request"]["method"] == "GET"
    assert apache["http"]["response"]["status_code"] == 200 and apache["user_agent"]["original"] == "Mozilla/5.0"
    assert str(apache["@timestamp"]) == "2026-10-10 16:55:36"
    cef = one(formats.parse_lines(lines("CEF:0|V|P|1.0|100|worm stopped|10|src=10.0.0.1 dst=2.1.2.2 spt=1232 msg=two words here act=blocked"), "cef"))
    assert cef["observer"]["vendor"] == "V" and cef["event"]["severity"] == 10 and cef["source"]["port"] == 1232 and cef["message"] == "two words here"
    log4j = one(formats.parse_lines(lines("[2010-04-24 07:51:54,393] DEBUG - [main] BulkOps.main(): Execution begin."), "log4j"))
    assert log4j["process"]["thread"]["name"] == "main" and log4j["log"]["origin"]["function"] == "BulkOps.main()"
    bad = one(formats.parse_lines(lines("not a log"), "log4j"))
    assert bad["parse_errors"] == ["_grokparsefailure"]


def test_format_detection_order(lines):
    cases = {
        "CEF:0|a|b|c|d|e|5|src=1": "cef", "<34>1 2026-05-19T10:15:30Z h a p m msg": "syslog_5424", "<34>May 19 14:30:00 h p: m": "syslog_3164",
        "<134>2025-07-01T10:21:33Z h proc[12]: m": "syslog_iso", '1.1.1.1 - - [10/Oct/2026:13:55:36 +0000] "GET / HTTP/1.1" 200 5': "apache_common",
        "[2026-05-19 10:15:30,123] ERROR Some message": "log4j", "8=FIX.4.4|35=D|49=A|": "fix", "hello": None}
    rows = lines(*cases).select("value", formats.detect(F.col("value")).alias("f")).collect()
    assert {r["value"]: r["f"] for r in rows} == cases


def test_ssh_line(lines):
    df = formats.parse_lines(lines("<134>2025-10-21T03:14:07Z bastion-01 sshd[41022]: Failed password for invalid user admin from 141.98.10.62 port 51884 ssh2 technique=T1110 campaign=CMP-003"), "syslog_iso")
    row = one(df.select(*nested.nest(formats.ssh_fields(F.col("message"), F.col("process.name")))))
    assert row["user"]["name"] == "admin" and row["source"]["ip"] == "141.98.10.62" and row["event"]["outcome"] == "failure"
    assert row["event"]["campaign"] == "CMP-003" and row["security"]["denied"] == "1"


SLF4J = "2026-01-05 11:00:00.250 INFO [SessionThread] quickfix.msg.incoming - FIX.4.4:OMS->MKT: "


def test_fix_message(lines):
    msg = SLF4J + "8=FIX.4.4|9=200|35=8|34=5|49=MKT|56=OMS|52=20260105-14:00:00.000|60=20260105-13:59:59.500|150=8|39=8|103=3|54=1|54=2|32=10|31=2.5|9999=z|10=1|"
    r = one(fix.decode(lines(msg), "slf4j"))
    assert r["fix_msg_type"] == "Reporte de ejecución" and r["fix_side"] == "Compra" and r["fix_other"] == {"tag_9999": "z"}
    assert r["fix_direccion"] == "entrante" and r["fix_contraparte"] == "MKT" and r["fix_comp_id_propio"] == "OMS"
    assert r["fix_rechazo_motivo"] == "Excede el límite de la orden" and r["fix_monto_ejecutado"] == 25.0
    assert r["fix_latencia_ms"] == 250 and r["fix_demora_ms"] == 500 and r["fix_capa"] == "aplicación"


def test_fix_event_and_unbelievable_latency(lines):
    ev = one(fix.decode(lines(SLF4J + "MsgSeqNum too high, expecting 10 but received 14"), "slf4j"))
    assert ev["fix_tipo_evento"] == "secuencia_alta" and ev["fix_salto_secuencia"] == 4 and ev["fix_capa"] == "evento" and ev["fix_contraparte"] == "MKT"
    late = one(fix.decode(lines(SLF4J + "8=FIX.4.4|35=0|49=MKT|56=OMS|52=20260105-13:00:00|"), "slf4j"))
    assert late["fix_latencia_ms"] is None and late["fix_capa"] == "sesión"
    assert one(fix.decode(lines("garbage"), "slf4j"))["parse_errors"] == ["_fix_sin_formato"]


def test_fix_detection(lines):
    d = one(fix.detect(lines(*[SLF4J + "8=FIX.4.4|35=D|"] * 4, *[SLF4J + "logon"] * 5)))
    assert d["envelope"] == "slf4j" and d["is_fix"]
    assert not one(fix.detect(lines(*["plain text"] * 5)))["is_fix"]


def test_dates(lines):
    df = lines("20251113014806726")
    assert str(one(df.select(dates.parse(F.col("value"), "yyyyMMddHHmmssSSS", dates.DEFAULT_ZONE).alias("t")))["t"]) == "2025-11-13 04:48:06.726000"
    assert values(lines("31/02/2024", "13/04/2024", "1/1/1950"), dates.parse(F.col("value"), "dd/MM/yyyy"))[0] is None
    assert one(lines("1").select(dates.months_between("2025-11", "2026-01").alias("m")))["m"] == ["2025_11", "2025_12", "2026_01"]
    assert str(one(lines("x").select(dates.merge_date_time(F.lit("2026-04-13"), F.lit("21:08:17"), "yyyy-MM-dd").alias("t")))["t"]) == "2026-04-13 21:08:17"


def test_numbers(lines):
    cases = {"1.234,5": (None, 1234.5), "1,234.5": (1234.5, None), "$ 1.500": (1.5, 1500.0), "15%": (15.0, 15.0), "1.23.4": (None, None), "-0,5": (None, -0.5), "abc": (None, None)}
    rows = lines(*cases).select("value", numbers.parse(F.col("value"), ".").alias("p"), numbers.parse(F.col("value"), ",").alias("c")).collect()
    assert {r["value"]: (r["p"], r["c"]) for r in rows} == cases


def test_network_and_geo(lines):
    ips = {"10.0.0.1": True, "256.1.1.1": False, "::1": True, "2001:db8::8a2e:370:7334": True, "abc": False}
    assert {r[0]: r[1] for r in lines(*ips).select("value", net.is_ip(F.col("value"))).collect()} == ips
    df = lines("-34.9,-57.9", "0,0", "91,10", "x")
    got = values(df, net.geo_point_from_text(F.col("value")))
    assert got[0]["lat"] == -34.9 and got[1:] == [None, None, None]
    assert values(lines("x"), net.geohash(F.lit(57.64911), F.lit(10.40744), 5)) == ["u4pru"]


def test_text_helpers(lines):
    assert values(lines("createSecurityGroupRule", "BILL_PAYMENT"), text.readable(F.col("value"))) == ["create Security Group Rule", "BILL PAYMENT"]
    assert values(lines("  Árbol   Ñandú "), text.fold(F.col("value"))) == ["arbol nandu"]
    got = values(lines("Failed password for root", "password failed"), text.contains_phrase(F.col("value"), "failed PASSWORD"))
    assert got == [True, False]
    w = text.spaced_words(F.col("value"))
    assert values(lines("The cat, the hat"), text.occurrences(w, "the")) == [2.0] and values(lines("The cat, the hat", ""), text.word_count(w)) == [4.0, 0.0]


def test_flatten_promote_and_maps(spark):
    df = spark.createDataFrame([((1, ("x",)), [("p",), ("q",)], 7)], "a struct<i:int,d:struct<t:string>>, arr array<struct<v:string>>, id int")
    assert one(nested.flatten(df)).asDict() == {"a_i": 1, "a_d_t": "x", "arr_v": "p", "id": 7}
    d = spark.createDataFrame([((1, "h"), "host1")], "data struct<id:int,host:string>, host string")
    assert one(nested.promote(d, "data")).asDict() == {"host": "host1", "id": 1, "host_original": "h"}
