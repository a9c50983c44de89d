import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumbre.sources import readers, sinks
from lumbre.streaming import jobs
from tests.conftest import one

T0 = dt.datetime(2026, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def files(spark, path, *batches, schema="id int, ts timestamp, v double"):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/b{i}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(f"{path}/in")


def test_dedup_within_the_watermark(spark, tmp_path):
    src = files(spark, tmp_path, [(1, at(0), 1.0), (1, at(1), 1.0)], [(1, at(2), 1.0), (2, at(3), 1.0)])
    out = jobs.run_once(jobs.dedup(src, "id", "ts"), f"{tmp_path}/out")
    assert sorted(r["id"] for r in out.collect()) == [1, 2]


def test_late_event_counts_within_the_delay(spark, tmp_path):
    src = files(spark, tmp_path, [(1, at(5), 1.0), (2, at(65), 1.0)], [(3, at(50), 1.0), (4, at(400), 1.0)], [(5, at(500), 1.0)])
    out = jobs.run_once(jobs.windowed_counts(src, "ts", "1 hour", "30 minutes", {"n": F.count(F.lit(1))}), f"{tmp_path}/out")
    assert {str(r["bucket"]): r["n"] for r in out.collect()}["2026-01-01 00:00:00"] == 2


def test_profile_merges_batches_and_ignores_a_replay(spark, tmp_path):
    path = f"{tmp_path}/p"
    action = jobs.profile_merger(path, "id", "ts", ["v"])
    first = spark.createDataFrame([(1, at(0), 2.0), (2, at(1), None)], "id int, ts timestamp, v double")
    action(first, 0)
    action(first, 0)
    action(spark.createDataFrame([(1, at(9), 4.0)], "id int, ts timestamp, v double"), 1)
    got = {r["entity"]: r for r in jobs.read_profile(spark, path, ["v"]).collect()}
    assert got[1]["events"] == 2 and got[1]["avg_v"] == 3.0 and got[1]["last"] == at(9) and got[2]["avg_v"] == 0


def test_throttle_batch_and_stream_agree(spark, tmp_path):
    times = [0, 10, 59, 61, 70, 130, 300]
    alerts = spark.createDataFrame([("m", at(t)) for t in times], "m string, at timestamp")
    batch = [r["at"] for r in jobs.throttled_alerts(alerts, "m", "at").orderBy("at").collect()]
    assert batch == [at(0), at(61), at(130), at(300)]
    alerts.coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("m string, at timestamp").parquet(f"{tmp_path}/in")
    out = jobs.run_once(jobs.throttled_alert_stream(src, "m", "at"), f"{tmp_path}/out")
    assert sorted(r["at"] for r in out.collect()) == batch


@pytest.mark.parametrize("asked, days", [(None, 121), (0, 121), ("x", 121), (1, 38), (7, 38), (90, 121), (99999, 3681)])
def test_days_to_drop(spark, asked, days):
    months = spark.createDataFrame([("2026_01",)], "month string")
    born = dt.date(2026, 1, 1)
    assert [one(jobs.retention_plan(months, born + dt.timedelta(days=d), asked))["action"] for d in (days - 1, days)] == ["warm", "drop"]


def test_retention_drops_and_compacts(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(i, dt.datetime(2026, m, 3), 1.0) for m in (1, 5, 6) for i in range(40)]
    sinks.write_monthly(spark.createDataFrame(rows, "id int, ts timestamp, v double").repartition(4), path, "ts")
    done = jobs.apply_retention(spark, path, dt.date(2026, 6, 20), 90)
    assert done == [("2026_01", "drop"), ("2026_05", "warm")]
    left = {r["month"]: r["n"] for r in sinks.read_months(spark, path).groupBy("month").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert left == {"2026_05": 40, "2026_06": 40}
    assert one(sinks.read_months(spark, path, ["2026_06"]).agg(F.count(F.lit(1)).alias("n")))["n"] == 40


def test_jdbc_round_trip_with_tracking_column(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.createDataFrame([(i, f"n{i}") for i in range(1, 11)], "ID int, NAME string")
    sinks.write_jdbc(df, url, "T1", driver, connections=2)
    new = readers.read_jdbc_since(spark, url, "T1", "ID", 7, driver)
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThan(ID,7)]" in new._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["ID"] for r in new.collect()) == [8, 9, 10] and readers.high_water_mark(new, "ID") == 10
    assert readers.read_jdbc_since(spark, url, "T1", "ID", driver=driver, bounds=(1, 11), partitions=3).count() == 10


def test_text_reader_gzip_encoding_and_comments(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("# c\ncaf\xe9 uno\r\n\n".encode("iso-8859-1"))
    (tmp_path / "empty.log").write_bytes(b"")
    assert [r["value"] for r in readers.read_lines(spark, str(tmp_path), "ISO-8859-1").collect()] == ["café uno"]


def test_archive_and_quarantine(spark, tmp_path):
    df = spark.createDataFrame([(1, at(0), []), (2, at(60 * 24 * 40), ["_bad"])], "id int, ts timestamp, parse_errors array<string>")
    sinks.write_archive(df, f"{tmp_path}/arch", "ts")
    assert spark.read.json(f"{tmp_path}/arch/transactions").where("month = '02'").count() == 1
    sinks.write_quarantined(df, f"{tmp_path}/good", f"{tmp_path}/bad")
    assert spark.read.parquet(f"{tmp_path}/good").columns == ["id", "ts"] and spark.read.parquet(f"{tmp_path}/bad").count() == 1


def test_kafka_options_and_rows(spark):
    o = readers.kafka_options("b:9093", ["t1", "t2"], "u", "p")
    assert o["subscribe"] == "t1,t2" and o["startingOffsets"] == "earliest" and o["kafka.security.protocol"] == "SASL_SSL"
    r = one(sinks.kafka_rows(spark.createDataFrame([(1, "x")], "id int, v string"), "id"))
    assert r["key"] == "1" and r["value"] == '{"id":1,"v":"x"}'


def test_stream_archives_what_it_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.log").write_text(f"line {i}\n")
    src = readers.stream_lines(spark, f"{tmp_path}/in", archive=f"{tmp_path}/done", max_files=1)
    assert jobs.run_once(src, f"{tmp_path}/out").count() == 3
