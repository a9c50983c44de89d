import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumbre.operators import aggregates as ag, change, derived, joins, scan, search, security, series
from lumbre.plans import profile as pf, roles
from lumbre.sources import readers, sinks
from tests.conftest import one

T0 = dt.datetime(2026, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_top_terms_skip_null_and_break_ties_by_key(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,), (None,), ("c",), ("c",)], "k string")
    assert [(r["k"], r["value"]) for r in ag.top_terms(df, "k", 2).collect()] == [("c", 2), ("a", 1)]


def test_array_counts_once_per_distinct_element(spark):
    df = spark.createDataFrame([(["x", "x", "y"],), (["x"],)], "k array<string>")
    assert {r["k"]: r["value"] for r in ag.array_terms(df, "k").collect()} == {"x": 2, "y": 1}


def test_exact_percentiles_match_the_builtin_on_a_skewed_group(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([0.0, -1.5, 7.25, rng.uniform(-1000, 1000)])) for _ in range(3000)] + [("one", 4.0), ("zero", 0.0), ("zero", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["percent"]): r["value"] for r in ag.exact_percentiles(df, ["k"], "v").collect()}
    want = df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p / 100.0) for p in ag.PERCENTILES])).alias("p")).collect()
    for r in want:
        for p, v in zip(ag.PERCENTILES, r["p"]):
            assert got[(r["k"], float(p))] == pytest.approx(v, abs=1e-9)


def brute_window(left, right, w, before):
    out = {}
    for k, t in left:
        n = sum(1 for k2, t2 in right if k2 == k and (t - (w if before else 0)) <= t2 <= t + w)
        if n:
            out[(k, t)] = n
    return out


@pytest.mark.parametrize("before", [True, False])
def test_window_matches_equal_brute_force_with_a_hot_key(spark, before):
    rng = random.Random(5)
    left = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", rng.randrange(0, 4000)) for _ in range(150)]
    right = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", rng.randrange(0, 4000)) for _ in range(150)]
    df = lambda rows: spark.createDataFrame([(k, at(t)) for k, t in rows], "k string, ts timestamp")
    got = {(r["k"], int((r["ts"] - T0).total_seconds() // 60)): r["n_right"] for r in joins.window_matches(df(left), df(right), "k", "ts", 45 * 60, before).collect()}
    assert got == brute_window(left, right, 45, before)


def test_nearest_equals_brute_force(spark):
    rng = random.Random(7)
    probes = [("a" if rng.random() < 0.7 else "b", rng.randrange(0, 3000)) for _ in range(80)]
    points = sorted({("a" if rng.random() < 0.7 else "b", rng.randrange(0, 3000)) for _ in range(60)})
    p = spark.createDataFrame([(i, k, at(t)) for i, (k, t) in enumerate(probes)], "id int, k string, ts timestamp")
    s = spark.createDataFrame([(k, at(t), float(t)) for k, t in points], "k string, ts timestamp, v double")
    got = {r["id"]: r["nearest_v"] for r in joins.nearest(p, s, ["k"], "ts", "v", 30 * 60_000_000).collect()}
    for i, (k, t) in enumerate(probes):
        near = [(abs(t2 - t), t2) for k2, t2 in points if k2 == k and abs(t2 - t) <= 30]
        assert got[i] == (float(min(near)[1]) if near else None)


def test_scans_across_chunks(spark):
    df = spark.createDataFrame([("s", n) for n in (1, 2, 5, 250000, 250001)], "k string, n bigint")
    assert [(r["previous"], r["n"], r["missing"]) for r in scan.sequence_gaps(df, ["k"], "n").orderBy("n").collect()] == [(2, 5, 2), (5, 250000, 249994)]
    rows = spark.createDataFrame([("s", 1, at(0)), ("s", 2, at(90)), ("s", 150000, at(60)), ("s", 150001, at(91))], "k string, a bigint, ts timestamp")
    late = one(scan.out_of_order(rows, ["k"], "a", "ts"))
    assert late["a"] == 150000 and late["late_ms"] == 30 * 60_000


def test_numbering_restarts(spark):
    rows = [(1, at(0), "x"), (2, at(0), "x"), (3, at(200), "reset"), (4, at(201), "x")]
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, id int, ts timestamp, e string")
    out = scan.sequence_numbers(df, ["k"], "ts", "id", F.col("e") == "reset", F.lit(1))
    assert [r["sequence"] for r in out.orderBy("id").collect()] == [1, 2, 1, 2]


def test_elapsed_takes_the_latest_start(spark):
    df = spark.createDataFrame([("a", at(0), "s"), ("a", at(100), "s"), ("a", at(130), "e"), ("b", at(5), "e")], "k string, ts timestamp, e string")
    r = one(joins.elapsed(df, ["k"], "ts", F.col("e") == "s", F.col("e") == "e"))
    assert r["k"] == "a" and r["elapsed_s"] == 1800


def test_entity_profile_nulls(spark):
    df = spark.createDataFrame([("a", at(0), None, None), ("a", at(1), 4.0, "bad"), ("b", at(2), None, None), (None, at(3), 1.0, None)], "e string, ts timestamp, v double, c string")
    p = {r["entity"]: r for r in derived.entity_profile(df, "e", "ts", [("v", "avg"), ("v", "max")], "c").collect()}
    assert set(p) == {"a", "b"} and p["a"]["avg_v"] == 4.0 and p["b"]["avg_v"] == 0 and p["b"]["max_v"] == 0 and p["a"]["critical"] == 1 and p["b"]["events"] == 1


def test_rates_are_averaged_before_they_are_summed(spark):
    df = spark.createDataFrame([("w1", at(0), 10.0), ("w1", at(120), 20.0), ("w2", at(0), 5.0)], "w string, ts timestamp, r double")
    assert one(ag.rate_total(df, "w", "ts", "r"))["total"] == 20.0


def test_funnel_array(spark):
    step = "array<struct<code:string,index:string,status:string,timedout:string,lateResp:string>>"
    df = spark.createDataFrame([([("confirm", "10", "E", "False", "True"), ("a", "0", "C", "False", "False"), ("b", "2", "C", "False", "False")],)], f"s {step}")
    f = one(df.select(derived.funnel(F.col("s")).alias("f")))["f"]
    assert f["steps_reached"] == ["a", "b", "confirm"] and f["steps_ok"] == ["a", "b"] and f["failed"] and f["failed_at_code"] == "confirm"
    assert f["deepest_ok_code"] == "b" and f["had_late_resp"] and not f["had_timeout"] and f["last_step_index"] == 10


def test_templates(spark):
    df = spark.createDataFrame([("user 12 logged from 10.0.0.1",), ("user 7 logged from 10.0.0.22",), ("disk full",)], "m string")
    assert {r["template"]: r["count"] for r in derived.text_templates(df, "m").collect()} == {"user <num> logged from <ip>": 2, "disk full": 1}


@pytest.mark.parametrize("days, rows, minutes", [(194, 99657, 480), (364, 75707, 1440), (211, 70332, 720), (165, 153973, 480), (3, 500, 60), (50, 100, 1440), (1095, 1000, 15840)])
def test_forecast_interval(days, rows, minutes):
    assert series.forecast_interval(T0, T0 + dt.timedelta(days=days), rows) == minutes


def test_detection_interval():
    assert series.detection_interval(T0, T0 + dt.timedelta(days=365)) == 525
    assert series.detection_interval(T0, T0 + dt.timedelta(minutes=30)) == 1


def _series(spark, ys):
    return spark.createDataFrame([(i, at(60 * i), float(y)) for i, y in enumerate(ys)], "step bigint, bucket timestamp, y double")


def test_planted_anomaly_and_quiet_series(spark):
    rng = random.Random(1)
    ys = [100 + rng.uniform(-5, 5) for _ in range(120)]
    ys[100:104] = [400, 420, 410, 405]
    grades = {r["step"]: r["grade"] for r in series.anomaly_grades(_series(spark, ys), ["y"], shingle=4).collect()}
    assert max(grades.values()) >= 0.7 and max(grades, key=grades.get) in range(100, 106)
    assert max(v for k, v in grades.items() if k < 100) < 0.7


def test_seasonal_forecast_of_a_perfect_season(spark):
    s = _series(spark, [(i % 24) * 10 for i in range(24 * 6)])
    out = series.forecast(s, "y", 24).orderBy("horizon_index").collect()
    assert [r["forecast"] for r in out] == [0, 10, 20, 30, 40, 50, 60, 70]
    assert all(r["lower"] <= r["forecast"] <= r["upper"] for r in out)


def test_errors_null_without_reference_and_anchor(spark):
    fc = spark.createDataFrame([(at(0), at(60), 3.0)], "origin_at timestamp, target_at timestamp, forecast double")
    actual = lambda v: spark.createDataFrame([(at(61), v)], "target_at timestamp, actual double")
    assert one(series.wape(fc, actual(0.0), 3_600_000_000))["wape_pct"] is None
    assert one(series.wape(fc, actual(4.0), 3_600_000_000))["wape_pct"] == 25.0
    assert one(series.mape(fc, actual(0.0), 3_600_000_000))["mape_pct"] is None
    assert one(series.choose_anchor(_series(spark, [1] * 10 + [0] * 8), "y", 8))["anchor"] == 5


def test_trend_and_gaps(spark):
    s = _series(spark, [1, 2, 3, 4, 5, 6, 7, 8])
    assert [r["trend"] for r in series.moving_average(s, "y").orderBy("step").collect()][5:] == [None, 4.0, 5.0]
    gaps = series.fill_gaps(s.where("step NOT IN (2, 3)"), 60, ["y"]).orderBy("step").collect()
    assert [r["y"] for r in gaps] == [1, 2, 0, 0, 5, 6, 7, 8]


def test_windows_of_a_point_and_of_an_interval():
    w = change.Comparison.around(T0)
    assert (w.end - w.start) == dt.timedelta(hours=2) and w.baseline_start == w.start - dt.timedelta(hours=24)
    w = change.Comparison.of(T0, T0 + dt.timedelta(days=2))
    assert w.baseline_start == T0 - dt.timedelta(days=6)
    with pytest.raises(ValueError):
        change.Comparison.of(T0, T0)


def test_changes_ignore_coordinates_and_derived_failures(spark):
    shares = spark.createDataFrame([("estado", "down", 0.9, 0.1), ("estado", "up", 0.1, 0.9), ("geo.lat", "-34", 1.0, 0.0), ("estado_falla", "x", 1.0, 0.5), ("msg", "new", 0.4, None), ("msg", "old", 0.2, 0.1)],
                                   "field string, value string, selection double, base double")
    rows = change.distribution_changes(shares).collect()
    assert [r["field"] for r in rows] == ["estado", "msg"] and rows[0]["value"] == "down"
    assert [r["value"] for r in change.pattern_changes(shares, "msg").collect()] == ["new", "old"]


def test_rules_once_per_event_with_phrase(spark):
    df = spark.createDataFrame([(1, "block", "Failed password for root"), (2, "allow", None), (3, "block", "ok")], "id int, action string, msg string")
    rules = [security.Rule("a", "high", {"action": ["block", "drop"], "msg|contains": ["failed password", "nope"]}), security.Rule("b", "low", {"action": "block"})]
    got = sorted((r["id"], r["rule"], r["severity"]) for r in security.findings(df, rules).collect())
    assert got == [(1, "a", 2), (1, "b", 4), (3, "b", 4)]


def test_profile_types(spark):
    rows = [("12.000", "01/02/2024", "865,5", "000", "sí", "1.1.1.1", "1751338866000", "13/02/2024", None, "t"), ("13.500", "03/04/2024", "1.234,5", "123", "no", "::1", "1751338867000", "01/02/2024", "-", "false")]
    df = spark.createDataFrame(rows, "miles string, f string, dec string, cod_x string, si string, ip string, ts string, d2 string, vacia string, b string")
    p = {r["column"]: r for r in pf.profile(df).collect()}
    assert p["miles"]["type"] == "integer" and p["miles"]["decimal"] == ","
    assert p["f"]["date_format"] == "dd/MM/yyyy" and p["dec"]["type"] == "float" and p["dec"]["decimal"] == ","
    assert p["cod_x"]["type"] == "string" and p["si"]["type"] == "string" and p["ip"]["type"] == "ip" and p["b"]["type"] == "boolean"
    assert p["ts"]["date_format"] == "UNIX_MS" and p["vacia"]["empties"] == 2 and p["vacia"]["type"] == "string"
    typed = pf.apply_plan(df, pf.plan_rows(pf.profile(df)), None).orderBy("miles").collect()
    assert typed[0]["miles"] == 12000 and typed[1]["dec"] == 1234.5 and typed[0]["parse_errors"] == []


def test_sketch_profile_agrees_on_types(spark):
    df = spark.createDataFrame([(str(i), f"2024-01-{i % 28 + 1:02d}", "x" if i % 2 else "y") for i in range(200)], "n string, d string, k string")
    exact, sketch = ({r["column"]: r["type"] for r in pf.profile(df, exact=e).collect()} for e in (True, False))
    assert exact == sketch == {"n": "integer", "d": "date", "k": "string"}


def test_roles_and_privacy(spark):
    names = ["user.name", "user_agent", "accountId", "user.type", "user.domain.name", "amount", "status_code"]
    df = spark.createDataFrame([(n, "float" if n == "amount" else "string") for n in names], "column string, type string")
    got = {r["column"]: (r["s"], r["r"]) for r in df.select("column", roles.sensitive(F.col("column")).alias("s"), roles.role(F.col("column"), F.col("type")).alias("r")).collect()}
    assert [n for n in names if got[n][0]] == ["user.name", "accountId"]
    assert got["amount"][1] == "measure" and got["status_code"][1] == "success_indicator" and got["user.name"][1] == "entity_id"
    paths = spark.createDataFrame([("[a][B]",), ("a.b",), ("[a].b",), ("",)], "p string")
    assert [r[0] for r in paths.select(roles.normalize_path(F.col("p"))).collect()] == ["a.b", "a.b", "a.b", ""]


def test_search_ranks_and_hybrid(spark):
    docs = spark.createDataFrame([(1, "the red car"), (2, "red red wine"), (3, "blue sky"), (4, "cars painted red")], "id int, t string")
    assert [r["id"] for r in search.bm25(docs, "id", "t", "red wine", 3).collect()][0] == 2
    assert {r["id"] for r in search.bm25(docs, "id", "t", "painting", 3, stem=True).collect()} == {4}
    assert search.hashed_top(docs, "id", "t", "blue sky", 1).first()["id"] == 3
    mixed = search.hybrid(search.bm25(docs, "id", "t", "red", 3), search.hashed_top(docs, "id", "t", "blue sky", 1), "id", 4).collect()
    assert mixed[0]["id"] == 3 and mixed[0]["score"] == pytest.approx(0.7)


def test_themes_refuse_repeats_and_variants(spark):
    texts = spark.createDataFrame([("caja rota",), ("caja golpeada",), ("llegó roto",), ("caja rota, control",)], "text string")
    themes = spark.createDataFrame([("t1", ["Caja rota", "caja golpeada", "llego roto"]), ("t2", ["caja rota", "caja golpeada", "llegó roto"]), ("t3", ["caja rota", "caja rota, control", "caja golpeada"])], "theme string, forms array<string>")
    assert [r["theme"] for r in search.valid_themes(themes, texts).collect()] == ["t1"]


def test_records_across_blocks_and_limits(spark):
    rows = [("f", 0, 1, "S one"), ("f", 0, 2, " at a"), ("f", 1, 3, " at b"), ("f", 1, 4, "S two"), ("f", 2, 5, " at c"), ("g", 0, 6, "loose"), ("g", 0, 7, "S x")]
    df = spark.createDataFrame(rows, "file string, block int, n int, value string")
    out = readers.assemble_records(df, F.col("value").startswith("S"), ["file", "block"], "n").collect()
    assert sorted((r["value"], r["lines"]) for r in out) == [("S one\n at a\n at b", 3), ("S two\n at c", 2), ("S x", 1), ("loose", 1)]
    long = spark.createDataFrame([("f", 0, i, "S" if i == 0 else f"c{i}") for i in range(25)], "file string, block int, n int, value string")
    pieces = readers.assemble_records(long, F.col("value").startswith("S"), ["file", "block"], "n", max_lines=10).collect()
    assert sorted(r["lines"] for r in pieces) == [5, 10, 10] and "\n".join(r["value"] for r in sorted(pieces, key=lambda r: r["record"])).split("\n") == ["S"] + [f"c{i}" for i in range(1, 25)]


def test_quoted_records(spark):
    rows = [("f", 1, 'a,"one'), ("f", 2, ""), ("f", 3, 'two",x'), ("f", 4, "b,c,d"), ("f", 5, 'e,"open')]
    df = spark.createDataFrame(rows, "file string, n int, value string")
    assert sorted((r["value"], list(r["parse_errors"])) for r in readers.quoted_records(df, ["file"], "n").collect()) == [
        ('a,"one\n\ntwo",x', []), ("b,c,d", []), ('e,"open', ["_record_unfinished"])]


def test_a_quoted_record_has_any_number_of_lines(spark):
    rows = [("f", 0, 'a,"0')] + [("f", i, str(i)) for i in range(1, 700)] + [("f", 700, 'end"'), ("f", 701, "b,c")]
    got = readers.quoted_records(spark.createDataFrame(rows, "file string, n int, value string").repartition(3), ["file"], "n").collect()
    assert sorted(r["lines"] for r in got) == [1, 701] and not any(r["parse_errors"] for r in got)


def test_latest_by_id_and_upsert(spark, tmp_path):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 1, "keep")], "id string, v int, x string")
    path = str(tmp_path / "t")
    sinks.upsert(spark, path, base, "id", "v")
    sinks.upsert(spark, path, spark.createDataFrame([("a", 2, "new"), ("c", 1, "add")], "id string, v int, x string"), "id", "v")
    assert sorted(tuple(r) for r in sinks.current_table(spark, path).collect()) == [("a", 2, "new"), ("b", 1, "keep"), ("c", 1, "add")]
