"""Queries on small tables of the shapes that larger runs have: other keys, other files."""

import datetime as dt

import __spark_entry__ as e
from tests.oracle import compare, connect

T0 = dt.datetime(2024, 1, 1)


def on_events(spark, con, tmp_path, name, rows):
    """What a query gives on events (user_id, event_type, value), and what differs from its SQL."""
    full = [(i, T0 + dt.timedelta(minutes=i), u, k, float(v), "{}") for i, (u, k, v) in enumerate(rows)]
    spark.createDataFrame(full, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/base/events.parquet")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/base/events.parquet/*.parquet')")
    return compare(con, e.queries()[name](spark, f"{tmp_path}/base"), e.oracle_sql()[name])


def test_user_numbers_are_no_administration_ports(spark, tmp_path):
    import duckdb
    users = (22, 44, 46, 3389, 5900, 50_022, 105_900, 5_000_000_000, 2 ** 40 + 22, None)
    assert on_events(spark, duckdb.connect(), tmp_path, "curated_firewall_rules", [(u, k, v) for u in users for k in ("view", "purchase") for v in (10, 70)]) == ""


def test_a_stream_reads_a_table_of_several_files(spark, tmp_path):
    import hashlib
    rows = [(i // 3, i % 3, "user", f"text {i % 5}") for i in range(30)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").repartition(3).write.parquet(f"{tmp_path}/base/conversations.parquet")
    got = {(r["digest"], r["count"]) for r in e.queries()["stream_distinct_texts"](spark, f"{tmp_path}/base").collect()}
    assert got == {(hashlib.md5(f"text {i}".encode()).hexdigest(), 6) for i in range(5)}
    events = spark.createDataFrame([(1, T0, 7, "view", 1.0, "{}"), (2, T0, 7, "view", 1.0, "{}")], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    events.repartition(2).write.parquet(f"{tmp_path}/base/events.parquet")
    assert [tuple(r) for r in e.queries()["stream_dedup"](spark, f"{tmp_path}/base").collect()] == [(2, 2)]


def test_an_index_tells_a_word_once_for_many_texts(spark, tmp_path):
    import hashlib
    from lumbre.operators import text_index as ti
    texts = [f"pump valve n{i:03d}" for i in range(300)]
    index = ti.TextIndex(spark, f"{tmp_path}/i", buckets=4).build(spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3), "id", "t")
    stored = spark.read.parquet(f"{tmp_path}/i/postings").where("term = 'pump' AND field = 'words'").count()
    assert stored <= 20 and index.postings({"words": ["pump"]}).count() == 300
    found = [r["text_id"] for r in index.search("pump", 10).collect()]  # all tie
    assert found == sorted(hashlib.sha256(x.encode()).hexdigest() for x in texts)[:10]


def test_pieces_of_a_stream_arrive_from_many_tasks(spark, tmp_path, monkeypatch):
    from lumbre.queries import streams
    monkeypatch.setattr(streams, "scratch_path", lambda _spark, name: f"{tmp_path}/{name}")
    spark.createDataFrame([(i, f"a{i}\nb") for i in range(400)], "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/base/documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = e.queries()["stream_multiline"](spark, f"{tmp_path}/base").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 400 and {r["lines"] for r in got} == {2}
    assert len(list(tmp_path.glob("**/arrivals/part-*.parquet"))) > 8  # four pieces


def test_a_profile_reads_its_table_once(spark):
    from pyspark.sql import functions as F
    from lumbre.plans import profile as pf
    read = spark.sparkContext.accumulator(0)

    def told(i):
        read.add(1)
        return f"{i % 28 + 1:02d}/02/2024"

    df = spark.range(60).select(F.udf(told, "string")("id").alias("fecha"), F.lit("31/02/2024").alias("bad"))
    got = {r["column"]: (r["type"], r["date_format"]) for r in pf.profile(df).collect()}
    assert got == {"fecha": ("date", "dd/MM/yyyy"), "bad": ("string", None)} and read.value == 60


def test_a_fix_time_is_parsed_once(spark, lines):
    from lumbre.plans import fix
    head = "2024-01-02 09:00:00.123 INFO [t1] quickfix.incoming - FIX.4.4:OMS->MKT: "
    d = fix.decode(lines(head + "junk 8=FIX.4.4|35=8|49=MKT|52=20240102-12:00:00.5|60=20240102-12:00:00|11=a=b|11=c|x54=1||54=2|=7|58=two lines|9999=|"), "slf4j")
    row = d.select("fix_cl_ord_id", "fix_side", "fix_text", "fix_other", "fix_latencia_ms", "fix_demora_ms").first()
    assert tuple(row) == ("a=b", "Venta", "two lines", {"tag_9999": ""}, -377, 500)
    plan = d.select("fix_latencia_ms")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("to_utc_timestamp") == 1


def test_steps_are_sorted_once_for_all_fields(spark):
    from pyspark.sql import functions as F
    from lumbre.operators import derived
    steps = [("c", "2147483647", "E", "False", "True"), ("a", "-5", "C", "False", None), None, ("b", "x", "C", "True", "False")]  # extremes overflow when subtracted
    df = spark.createDataFrame([(1, steps), (2, []), (3, None)], "id int, s array<struct<code:string,index:string,status:string,timedout:string,lateResp:string>>").repartition(1)
    d = df.select("id", derived.funnel(F.col("s")).alias("f"))
    got = {r["id"]: r["f"] for r in d.collect()}
    assert tuple(got[1]) == (4, 2, ["a", None, "b", "c"], ["a", "b"], "c", 2147483647, "E", "b", True, None, True, True) and got[2] is got[3] is None
    assert d._jdf.queryExecution().optimizedPlan().toString().count("sort_array") == 1


def test_a_long_record_is_joined_by_slices(spark, monkeypatch):
    from pyspark.sql import functions as F
    from lumbre.sources import readers
    monkeypatch.setattr(readers, "_LINES_AT_ONCE", 4)
    rows = [("f", i // 10, i, "S" if i == 3 else f"l{i}" if i % 7 else None) for i in range(35)] + [("g", 0, i, None) for i in range(9)]
    df = spark.createDataFrame(rows, "file string, block int, n int, value string").repartition(3)
    out = readers.assemble_records(df, F.col("value").startswith("S"), ["file", "block"], "n")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("_slice") > 0
    whole = "\n".join(["S"] + [f"l{i}" for i in range(4, 35) if i % 7])
    assert [(r["value"], r["lines"]) for r in out.where("size(parse_errors) = 0").collect()] == [(whole, 32)]
    cut = {r["value"]: r["lines"] for r in readers.assemble_records(df.where("file = 'f'"), F.col("value").startswith("S"), ["file"], "n", max_lines=10).where("value LIKE 'S%' OR value LIKE 'l%'").collect()}
    assert "\n".join(["S"] + [f"l{i}" for i in range(4, 13) if i % 7]) in cut and "\n".join(f"l{i}" for i in range(13, 23) if i % 7) in cut


def test_no_status_is_numbered_in_one_task(spark, tmp_path):
    import duckdb
    spark.createDataFrame([(k * 50_000, "OFP"[k % 3] if k < 30 else "X") for k in range(31)], "o_orderkey bigint, o_orderstatus string").write.parquet(f"{tmp_path}/base/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/base/orders.parquet/*.parquet')")
    df = e.queries()["long_quoted_records"](spark, f"{tmp_path}/base")
    assert compare(con, df, e.oracle_sql()["long_quoted_records"]) == ""
    windows = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x and "row_number()" in x]
    assert windows and all("block" in x or "_chunk" in x for x in windows)
