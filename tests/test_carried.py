"""State between micro-batches, keyed tables, increments and the text index."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lumbre.operators import text_index as ti
from lumbre.sources import keyed, sinks
from lumbre.sources.increments import Increments
from lumbre.streaming import carried, jobs

T0 = dt.datetime(2026, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


BEGINS = lambda c: c.rlike("^[0-9]{2}:")


def lines_of(spark, *rows):
    return spark.createDataFrame(rows, "source string, offset bigint, value string")


def test_a_record_stays_open_over_batches(spark, tmp_path):
    path = f"{tmp_path}/r"
    action = carried.record_assembler(spark, path, BEGINS, slice_lines=2)
    action(lines_of(spark, ("a", 0, "lost tail"), ("a", 1, "10: one"), ("a", 2, " more")), 0)
    action(lines_of(spark, ("a", 3, " still"), ("b", 0, "11: b")), 1)
    action(lines_of(spark, ("a", 3, " still"), ("b", 0, "11: b")), 1)  # the batch comes again
    closed = [r["value"] for r in carried.records(spark, path, BEGINS, open_too=False).collect()]
    assert closed == ["lost tail"]
    action(lines_of(spark, ("a", 4, " end"), ("a", 5, "12: two")), 2)
    got = {(r["source"], r["value"]): (r["lines"], r["parse_errors"]) for r in carried.records(spark, path, BEGINS).collect()}
    assert got == {("a", "lost tail"): (1, ["_no_record_start"]), ("a", "10: one\n more\n still\n end"): (4, []), ("a", "12: two"): (1, []), ("b", "11: b"): (1, [])}


EVENTS = "user int, kind string, ts timestamp"


def test_correlation_waits_for_the_window_and_forgets(spark, tmp_path):
    path, k = f"{tmp_path}/c", F.col("kind")
    action = carried.correlator(spark, path, k == "l", k == "r", "user", "ts", 3600, delay=600)
    batches = [[(1, "l", at(0)), (1, "r", at(10))], [(1, "r", at(60)), (1, "r", at(61)), (2, "l", at(50))], [(1, "r", at(500))], [(1, "l", at(5)), (2, "r", at(110))]]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, EVENTS)
        action(df, n)
        action(df, n)
    held = carried.Carried(spark, path)
    side = carried.sides(df.schema, "user", "ts")
    assert held.newest("left", side).count() == 0 and held.newest("right", side).count() == 1
    got = [(r["user"], r["ts"], r["n_left"], r["n_right"]) for r in carried.correlations(spark, path, df.schema, "user", "ts", 3600).collect()]
    assert got == [(1, at(0), 1, 2)]
    late = held.all("late", EVENTS).collect()  # what came after its window was closed is kept
    assert {(r["user"], r["kind"]) for r in late} == {(1, "l"), (2, "r")}


def test_tasks_end_or_time_out_and_leave_the_state(spark, tmp_path):
    path = f"{tmp_path}/t"
    schema = "id int, ts timestamp, over boolean, v double"
    action = carried.task_combiner(spark, path, "id", "ts", F.col("over"), ["v"], 600)
    batches = [[(1, at(0), False, 1.0), (2, at(1), False, 2.0)], [(1, at(2), True, 3.0), (1, at(3), False, 9.0)], [(3, at(60), None, None)]]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        action(df, n)
        action(df, n)
    rows = {(r["id"], r["first"], r["events"], r["v_sum"], r["outcome"]) for r in carried.combined_tasks(spark, path, df.schema, "id", ["v"]).collect()}
    assert rows == {(1, at(0), 2, 4.0, "ended"), (1, at(3), 1, 9.0, "timed_out"), (2, at(1), 1, 2.0, "timed_out"), (3, at(60), 1, None, "open")}
    assert carried.Carried(spark, path).newest("open", carried.task_schema(df.schema, "id", ["v"])).count() == 1


def test_throttle_state_leaves_with_the_watermark(spark, tmp_path):
    schema = "m string, at timestamp"
    for i, rows in enumerate([[("a", at(0)), ("b", at(5))], [("a", at(30))], [("c", at(400))], [("a", at(401))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    q = jobs.throttled_alert_stream(src, "m", "at", 60).writeStream.format("parquet").option("path", f"{tmp_path}/out") \
        .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    sent = sorted((r["m"], r["at"]) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect())
    assert sent == [("a", at(0)), ("a", at(401)), ("b", at(5)), ("c", at(400))]
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert states[-1] <= 2  # a and b of the first hour are gone


def test_an_update_rewrites_its_own_buckets(spark, tmp_path):
    path = f"{tmp_path}/k"
    table = keyed.KeyedTable(spark, path, "id", {"n": F.sum, "last": F.max}, buckets=8)
    schema = "id int, n bigint, last int"
    table.update(spark.createDataFrame([(i, 1, i) for i in range(100)], schema), 0)
    before = table.manifest()["folders"]
    files = {f: os.listdir(f"{path}/{f}") for f in before.values()}
    touched = table.update(spark.createDataFrame([(7, 5, 1), (7, 5, 2)], schema), 1)
    after = table.manifest()["folders"]
    assert len(touched) == 1 and [b for b in before if before[b] != after[b]] == [str(touched[0])]
    assert all(os.listdir(f"{path}/{f}") == files[f] for b, f in before.items() if int(b) not in touched)
    assert table.update(spark.createDataFrame([(8, 5, 9)], schema), 1) == []  # was applied before
    got = {r["id"]: (r["n"], r["last"]) for r in table.read().collect()}
    assert len(got) == 100 and got[7] == (11, 7) and got[8] == (1, 8)
    assert table.update(spark.createDataFrame([], schema), 2) == [] and table.read().count() == 100


def test_upsert_keeps_the_newer_version(spark, tmp_path):
    path, schema = f"{tmp_path}/u", "id string, v int, x string"
    assert keyed.current_table(spark, path) is None
    keyed.upsert(spark, path, spark.createDataFrame([("a", 1, "old"), ("b", 3, "keep"), (None, 1, "null key")], schema), "id", "v")
    keyed.upsert(spark, path, spark.createDataFrame([("a", 2, "new"), ("b", 2, "late")], schema), "id", "v")
    assert {tuple(r) for r in keyed.current_table(spark, path).collect()} == {("a", 2, "new"), ("b", 3, "keep"), (None, 1, "null key")}


def test_increments_read_every_row_once(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    put = lambda a, b: sinks.write_jdbc(spark.createDataFrame([(i, f"n{i}") for i in range(a, b)], "ID bigint, NAME string"), url, "T", driver, connections=1)
    source = Increments(spark, f"{tmp_path}/inc", url, "T", "ID", driver, partitions=3)
    put(0, 10)
    assert source.rows().count() == 0 and source.pull() == 1 and source.pull() is None
    put(10, 15)
    assert source.pull() == 2
    os.remove(f"{tmp_path}/inc/batch=000000000002/mark/_SUCCESS")  # it died before the mark was complete
    assert list(source.marks()) == [1]
    put(15, 18)  # more rows came before the batch is read again
    assert source.pull(again=2) == 2
    put(18, 20)
    assert source.pull() == 3
    assert sorted(r["ID"] for r in source.rows().collect()) == list(range(20))
    assert {n: m["mark"] for n, m in source.marks().items()} == {1: 9, 2: 17, 3: 19}
    with pytest.raises(ValueError):
        source.pull(again=1)


def test_a_question_reads_its_own_words(spark, tmp_path):
    rows = [(1, "the lost pump"), (2, "Pumps and pumps"), (3, "the lost pump"), (4, None), (5, "nothing"), (6, "")]
    index = ti.TextIndex(spark, f"{tmp_path}/i", buckets=16).build(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    found = [(r["id"], r["count"]) for r in index.search("lost PUMP", 5, {"words": ti.plain_words}).collect()]
    assert found == [(1, 2)]
    assert {r["id"] for r in index.search("lost PUMP", 5).collect()} == {1, 2}  # stems: pumps is pump
    plan = index.postings({"words": ["lost"]})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,lost)" in plan or "In(term" in plan
    assert index.search("absent").count() == 0 and index.search("").count() == 0
