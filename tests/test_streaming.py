"""Streams against batch results: files arrive one by one, then everything is drained."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import dq, truth
from tidewatch.streaming import alerts, windows
from tidewatch.streaming.sinks import to_table
from tidewatch.streaming.ticks import HourlyTicks

OUTCOME = "run_id string, analyser_type string, outcome string, severity string, violation_count bigint, started_at timestamp"
START = datetime(2024, 1, 1)


def outcome_rows(numbers, severity="alert"):
    return [(f"r{i}", "dq", "failed_unhandled", severity, 0, START + timedelta(minutes=i)) for i in numbers]


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_alerts_are_announced_once(spark, tmp_path):
    sent = []

    def notify(fresh, batch_id):
        sent.extend(r["run_id"] for r in fresh.collect())

    def drain():
        query = alerts.notify_once(stream(spark, tmp_path / "in", OUTCOME), str(tmp_path / "ledger"), str(tmp_path / "cp"), notify)
        query.awaitTermination()

    put(spark, tmp_path / "in", outcome_rows([1, 2, 2]), OUTCOME)
    drain()
    assert sorted(sent) == ["r1", "r2"]
    # an old alert again, a new one, one that is no alert, one without key, and one of another day
    more = outcome_rows([2, 3]) + outcome_rows([4], "warn") + [(None, "dq", "x", "alert", 0, START)] + outcome_rows([2000])
    put(spark, tmp_path / "in", more, OUTCOME)
    drain()
    assert sorted(sent) == ["r1", "r2", "r2000", "r3"]
    # the same rows through another query with the same ledger
    alerts.notify_once(stream(spark, tmp_path / "in", OUTCOME), str(tmp_path / "ledger"), str(tmp_path / "cp2"), notify).awaitTermination()
    assert len(sent) == 4


def test_a_rerun_on_another_day_and_a_run_without_start(spark, tmp_path):
    sent = []

    def drain(rows):
        put(spark, tmp_path / "in", rows, OUTCOME)
        notify = lambda fresh, batch_id: sent.extend(r["run_id"] for r in fresh.collect())
        alerts.notify_once(stream(spark, tmp_path / "in", OUTCOME), str(tmp_path / "ledger"), str(tmp_path / "cp"), notify).awaitTermination()

    late, early = datetime(2024, 1, 1, 23), datetime(2024, 1, 2, 1)
    drain([("r1", "dq", "x", "alert", 0, late), ("r2", "dq", "x", "alert", 0, None)])
    drain([("r1", "dq", "x", "alert", 0, early), ("r2", "dq", "x", "alert", 0, None), ("r2", "mq", "x", "alert", 0, None)])
    assert sorted(sent) == ["r1", "r2", "r2"]


def test_a_failed_notification_is_not_repeated(spark, tmp_path):
    put(spark, tmp_path / "in", outcome_rows([1]), OUTCOME)
    calls = []

    def failing(fresh, batch_id):
        calls.append(fresh.count())
        raise RuntimeError("pager is down")

    def fine(fresh, batch_id):
        calls.append(fresh.count())

    query = alerts.notify_once(stream(spark, tmp_path / "in", OUTCOME), str(tmp_path / "ledger"), str(tmp_path / "cp"), failing)
    with pytest.raises(Exception, match="pager is down"):
        query.awaitTermination()
    alerts.notify_once(stream(spark, tmp_path / "in", OUTCOME), str(tmp_path / "ledger"), str(tmp_path / "cp"), fine).awaitTermination()
    assert calls == [1, 0]


def test_archive_gives_ids_and_partitions(spark, tmp_path):
    schema = "event_id string, body string"
    put(spark, tmp_path / "in", [("e1", "a"), (None, "b")], schema)
    alerts.archive(stream(spark, tmp_path / "in", schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert len(rows) == 2 and all(r["event_id"] for r in rows) and {"dt", "hour"} <= set(rows[0].asDict())


CAPTURE = "ts timestamp, kind string, value double"


def captures():
    return [(START + timedelta(minutes=7 * i), "ab"[i % 3 == 0], float(i % 11)) for i in range(200)]


def split(spark, path, rows, schema, size=50):
    for i in range(0, len(rows), size):
        put(spark, path, rows[i : i + size], schema)


def test_window_psi_equals_batch_psi(spark, tmp_path):
    rows = captures()
    split(spark, tmp_path / "in", rows, CAPTURE)
    baseline = spark.createDataFrame([("a",)] * 6 + [("c",)] * 4, "kind string")
    histogram = dq.baseline_histogram(baseline, ["kind"])
    windows.monitor_windows(
        stream(spark, tmp_path / "in", CAPTURE), histogram, ["kind"], str(tmp_path / "out"), str(tmp_path / "cp")
    ).awaitTermination()
    got = {r["window_start"]: r["psi"] for r in spark.read.schema("window_start timestamp, column string, psi double").parquet(str(tmp_path / "out")).collect()}
    newest = max(r[0] for r in rows)
    hours = {r[0].replace(minute=0) for r in rows}
    assert set(got) == {h for h in hours if h + timedelta(hours=1) <= newest - timedelta(minutes=10)}
    hour = sorted(got)[3]
    live = spark.createDataFrame([(k,) for t, k, _ in rows if t.replace(minute=0) == hour], "kind string")
    assert got[hour] == pytest.approx(dq.population_stability(live, baseline, ["kind"]).first()["psi"])


def test_window_ks_equals_batch_ks(spark, tmp_path):
    rows = captures()
    split(spark, tmp_path / "in", rows, CAPTURE)
    live = windows.live_numbers(stream(spark, tmp_path / "in", CAPTURE), ["value"], "6 hours")
    to_table(live, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.schema(live.schema).parquet(str(tmp_path / "out"))
    baseline = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 5, 9)], "value double")
    got = {r["window_start"]: r["ks_stat"] for r in windows.window_ks(stored, dq.baseline_numbers(baseline, ["value"])).collect()}
    first = min(got)
    batch = spark.createDataFrame([(v,) for t, _, v in rows if first <= t < first + timedelta(hours=6)], "value double")
    assert got[first] == pytest.approx(dq.ks_statistic(batch, baseline, ["value"]).first()["ks_stat"])


CAPTURED, LABELLED = "inference_id string, ts timestamp", "inference_id string, label string, label_ts timestamp"
DAY = timedelta(days=1)


def test_many_windows_read_the_baseline_once(spark):
    """Rows behind the merge are as many as live values and baseline values, whatever the number of windows."""
    rng = random.Random(2)
    live = [(START + timedelta(hours=h), c, float(v), rng.randint(1, 5)) for h in range(40) for c in "xy" for v in rng.sample(range(60), 8)]
    base = [(c, float(v) + 0.5 * (v % 2), rng.randint(1, 9)) for c in "xyz" for v in range(-5, 70)]
    frames = spark.createDataFrame(live, "window_start timestamp, column string, number double, n bigint"), spark.createDataFrame(base, "column string, number double, m bigint")
    got = {(r["window_start"], r["column"]): r for r in windows.window_ks(*frames).collect()}
    assert len(got) == 80
    for (w, c), r in got.items():
        mine, theirs = [(v, n) for a, b, v, n in live if (a, b) == (w, c)], [(v, m) for b, v, m in base if b == c]
        n, m = sum(k for _, k in mine), sum(k for _, k in theirs)
        gap = max(abs(sum(k for v, k in mine if v <= x) / n - sum(k for v, k in theirs if v <= x) / m) for x in [v for v, _ in mine + theirs])
        assert (r["ks_stat"], r["n"], r["m"]) == (pytest.approx(gap, abs=1e-12), n, m)


def test_stability_of_windows_with_new_lost_and_null_categories(spark):
    live = [(START, "g", "a", 3), (START, "g", None, 1), (START, "g", "new", 2), (START + timedelta(hours=1), "g", "b", 5), (START, "other", "a", 1)]
    base = [("g", "a", 6), ("g", "b", 3), ("g", None, 1), ("h", "a", 2)]
    found = windows.window_stability(spark.createDataFrame(live, "window_start timestamp, column string, category string, n bigint"), spark.createDataFrame(base, "column string, category string, count bigint"))
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()
    got = {r["window_start"]: r["psi"] for r in found.collect()}
    for w in (START, START + timedelta(hours=1)):
        mine, theirs = {g: n for a, c, g, n in live if a == w and c == "g"}, {g: n for c, g, n in base if c == "g"}
        pairs = [(max(mine.get(g, 0) / sum(mine.values()), 1e-6), max(theirs.get(g, 0) / 10, 1e-6)) for g in {*mine, *theirs}]
        assert got[w] == pytest.approx(sum((p - q) * math.log(p / q) for p, q in pairs))
    assert len(got) == 2


def test_late_truth_waits_then_gives_up(spark, tmp_path):
    put(spark, tmp_path / "c", [("in", START), ("late", START), ("none", START), ("open", START + 30 * DAY)], CAPTURED)
    put(spark, tmp_path / "l", [("in", "y", START + 3 * DAY), ("in", "z", START + 5 * DAY), ("in", "x", START + 4 * DAY), ("late", "y", START + 9 * DAY), ("open", "y", START + 31 * DAY)], LABELLED)
    rows = windows.late_truth(stream(spark, tmp_path / "c", CAPTURED), stream(spark, tmp_path / "l", LABELLED), "INTERVAL 7 DAYS")
    to_table(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).collect()
    assert sorted((r["inference_id"], r["label"] or "-") for r in found) == [("in", "z"), ("late", "-"), ("none", "-")]


@pytest.fixture
def counted_state(spark):
    """Row counts of states in the progress of queries."""
    name = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    yield
    spark.conf.set(name, before)


def test_label_stream_equals_the_batch_join_and_forgets(spark, tmp_path, counted_state):
    """Captures of thirty days arrive day by day, with none to three labels each."""
    captured = [(f"c{d}-{k}", START + d * DAY + timedelta(hours=k)) for d in range(30) for k in range(6)]
    labelled = [(i, "xyz"[n], t + timedelta(days=2 * n + int(i[-1]), hours=n)) for i, t in captured for n in range(int(i[-1]) % 4)]
    for d in range(0, 30, 6):
        now, later = START + d * DAY, START + (d + 6) * DAY
        put(spark, tmp_path / "c", [c for c in captured if now <= c[1] < later], CAPTURED)
        put(spark, tmp_path / "l", [x for x in labelled if now <= x[2] < later], LABELLED)
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    rows = windows.late_truth(read("c", CAPTURED), read("l", LABELLED), "INTERVAL 7 DAYS", "1 day")
    query = to_table(rows, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = spark.read.schema(rows.schema).parquet(str(tmp_path / "out"))
    sizes = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) < len(captured) + len(labelled) and sizes[-1] < max(sizes)
    watermark = min(max(t for _, t in captured), max(t for _, _, t in labelled)) - DAY
    want = truth.settled_truth(spark.createDataFrame(captured, CAPTURED), spark.createDataFrame(labelled, LABELLED), watermark, "7d")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 100


def test_agreement_per_window(spark, tmp_path):
    schema = "id bigint, ts timestamp, prediction int"
    serving = [(i, START + timedelta(minutes=10 * i), i % 2) for i in range(40)]
    shadow = [(i, t + timedelta(minutes=1), p if i % 4 else 1 - p) for i, t, p in serving]
    split(spark, tmp_path / "a", serving, schema, 15)
    split(spark, tmp_path / "b", shadow, schema, 15)
    rates = windows.agreement(stream(spark, tmp_path / "a", schema), stream(spark, tmp_path / "b", schema), "id")
    to_table(rates, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = {r["window_start"]: (r["pairs"], r["agreement"]) for r in spark.read.schema(rates.schema).parquet(str(tmp_path / "out")).collect()}
    assert rows[START] == (6, pytest.approx(4 / 6)) and rows[START + timedelta(hours=1)] == (6, pytest.approx(5 / 6))


def test_hourly_tick_counts(spark, tmp_path):
    split(spark, tmp_path / "in", outcome_rows(range(0, 240, 10)), OUTCOME, 6)
    tick = windows.hourly_tick(stream(spark, tmp_path / "in", OUTCOME))
    to_table(tick, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.schema(tick.schema).parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [(r["runs"], r["alerts"]) for r in rows] == [(6, 6)] * 3


ARRIVED = "run_id string, analyser_type string, outcome string, severity string, violation_count bigint, started_at timestamp, duration_seconds double, dt string, hour int"


def arrivals(spark, path, rows):
    """(event hour, arrival hour, violations) as archived outcomes."""
    made = []
    for k, (event, arrival, n) in enumerate(rows):
        at = START + timedelta(hours=arrival)
        made.append((f"r{k}", "dq", "succeeded", "alert" if n > 3 else None, n, START + timedelta(hours=event, minutes=5), 1.5, at.strftime("%Y-%m-%d"), at.hour))
    spark.createDataFrame(made, ARRIVED).write.mode("append").partitionBy("dt", "hour").parquet(str(path))
    return spark.read.parquet(str(path))


def test_ticks_read_new_hours_only_and_count_late_events(spark, tmp_path):
    source = arrivals(spark, tmp_path / "in", [(0, 0, 1), (1, 1, 2), (1, 3, 5), (22, 26, 4), (26, 26, 1)])
    counted = HourlyTicks(str(tmp_path / "state"))
    hour = lambda h: START + timedelta(hours=h)
    by_hour = lambda unit="hour": {r["period"]: (r["runs"], r["violations"], r["alerts"], r["seconds"]) for r in counted.rollup(spark, unit).collect()}
    counted.tick(source, hour(2))
    assert by_hour() == {hour(0): (1, 1, 0, 1.5), hour(1): (1, 2, 0, 1.5)} and counted.mark(spark) == hour(2)
    plan = counted.due(source, hour(4))._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    assert plan.collectLeaves().head().metrics().apply("numFiles").value() == 1  # of five
    counted.tick(source, hour(4))
    assert by_hour()[hour(1)] == (2, 7, 1, 3.0)
    counted.tick(source, hour(27))
    assert by_hour() == {hour(0): (1, 1, 0, 1.5), hour(1): (2, 7, 1, 3.0), hour(22): (1, 4, 1, 1.5), hour(26): (1, 1, 0, 1.5)}
    assert by_hour("day") == {hour(0): (4, 12, 2, 6.0), hour(24): (1, 1, 0, 1.5)}
    assert [r["runs"] for r in counted.lookback(spark, hour(26), "5h").collect()] == [1]
    counted.tick(source, hour(27))  # nothing is due
    before = sorted(map(str, counted.partials(spark).inputFiles()))
    amended = arrivals(spark, tmp_path / "in", [(3, 3, 9)])
    counted.recompute(amended, [hour(3)])
    assert by_hour()[hour(3)] == (1, 9, 1, 1.5) and by_hour()[hour(1)] == (2, 7, 1, 3.0)
    changed = set(before) ^ set(counted.partials(spark).inputFiles())
    assert changed and all("dt=2024-01-01/hour=3" in f for f in changed)


def test_a_tick_that_died_before_its_mark_counts_once(spark, tmp_path):
    source = arrivals(spark, tmp_path / "in", [(0, 0, 1), (1, 1, 2)])
    counted = HourlyTicks(str(tmp_path / "state"))
    counted._write(counted.due(source, START + timedelta(hours=2)))
    counted.tick(source, START + timedelta(hours=2))
    assert counted.rollup(spark, "day").first()["runs"] == 2
    with pytest.raises(ValueError, match="full hour"):
        counted.tick(source, START + timedelta(hours=2, minutes=3))
