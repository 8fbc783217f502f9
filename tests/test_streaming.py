"""The same rows through several micro-batches must equal the batch operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rankloom.operators import alerts as al
from rankloom.operators import metrics as mx
from rankloom.operators.cache_replay import ttl_replay
from rankloom.operators.limiter import rate_limit
from rankloom.operators.monitor import outage_events
from rankloom.streaming import folds, tables, windows

T0 = datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp_ntz, id long, ok boolean, v double"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """600 rows in time order, stored as six files read one per micro-batch."""
    rng = random.Random(5)
    now, rows = 0, []
    for i in range(600):
        now += rng.choice([0, 1, 7, 30, 400 * (rng.random() < 0.05)])
        rows.append((rng.choice("abc"), T0 + timedelta(seconds=now), i, rng.random() < 0.6, rng.random() * 3))
    folder = str(tmp_path_factory.mktemp("feed"))
    for part in range(6):
        piece = spark.createDataFrame(rows[part * 100 : part * 100 + 100], SCHEMA).coalesce(1)
        piece.write.mode("append").parquet(f"{folder}/part={part}")
    return folder, spark.createDataFrame(rows, SCHEMA)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1).parquet(folder)


def drain(spark, df, name, tmp_path, mode="append"):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    batches = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(batches) >= 6
    return spark.table(name)


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("watermark", [None, "10 minutes"])
def test_limiter_stream(spark, feed, tmp_path, watermark):
    folder, rows = feed
    live = folds.stream_rate_limit(stream(spark, folder), "k", "ts", "id", 3, 60, watermark)
    out = drain(spark, live, f"limiter_{watermark is None}".lower(), tmp_path)
    assert out.where("late").count() == 0
    batch = rate_limit(rows, "k", "ts", "id", 3, 60)
    same(out.select("k", "id", "accepted"), batch.select("k", "id", "accepted"))


def test_cache_stream(spark, feed, tmp_path):
    folder, rows = feed
    out = drain(spark, folds.stream_ttl_cache(stream(spark, folder), "k", "ts", "id", 45), "cache", tmp_path)
    same(out.select("k", "id", "event"), ttl_replay(rows, "k", "ts", "id", 45).select("k", "id", "event"))


def test_monitor_stream(spark, feed, tmp_path):
    folder, rows = feed
    live = folds.stream_outage_events(stream(spark, folder), "k", "ts", "id", F.col("ok"), 2, 1, (30, 60))
    out = drain(spark, live, "monitor", tmp_path)
    batch = outage_events(rows, "k", "ts", "id", F.col("ok"), 2, 1, "00:30", "01:00")
    same(out.select("k", "id", "event"), batch.select("k", "id", "event"))


def test_late_rows_are_flagged(spark, tmp_path):
    folder = str(tmp_path / "late")
    times = [[0, 10], [5, 20], [20]]
    n = 0
    for part, seconds in enumerate(times):
        rows = []
        for s in seconds:
            rows.append(("a", T0 + timedelta(seconds=s), n, True, 0.0))
            n += 1
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={part}")
    live = folds.stream_rate_limit(stream(spark, folder), "k", "ts", "id", 9, 60)
    query = (
        live.writeStream.format("memory").queryName("late_rows").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {r.id: (r.accepted, r.late) for r in spark.table("late_rows").collect()}
    assert got == {0: (True, False), 1: (True, False), 2: (None, True), 3: (True, False), 4: (True, False)}


def test_window_stream(spark, feed, tmp_path):
    folder, rows = feed
    out = drain(
        spark, windows.stream_event_rate(stream(spark, folder), "ts", ["k"], 300, 30), "rates", tmp_path, "complete"
    )
    batch = mx.event_rate(rows, "ts", ["k"], 300, 30)
    same(out, batch.select(out.columns))


def test_latency_stream(spark, feed, tmp_path):
    folder, rows = feed
    bounds = mx.STAGE_BOUNDS["total"]
    live = windows.stream_latency(stream(spark, folder), "ts", F.col("v"), bounds, ["k"], 300, 60)
    out = drain(spark, live, "latency", tmp_path, "complete").select("window_start", "k", "requests", "quantile")
    batch = mx.latency_windows(rows, "ts", F.col("v"), bounds, ["k"], 300, 60)
    same(out, batch.select(out.columns))


def test_closed_windows_appear_once(spark, feed, tmp_path):
    folder, rows = feed
    live = windows.stream_event_rate(stream(spark, folder), "ts", ["k"], 300, 300, "1 minute")
    out = drain(spark, live, "closed", tmp_path)
    batch = mx.event_rate(rows, "ts", ["k"], 300, 300).select(out.columns)
    got, want = set(map(tuple, out.collect())), set(map(tuple, batch.collect()))
    assert got and got <= want and out.count() == len(got)


def test_alert_stream(spark, tmp_path):
    rng = random.Random(8)
    rows, when = [], 0
    for i in range(120):
        when += 30 if rng.random() < 0.95 else 90
        rows.append(("m", "s", T0 + timedelta(seconds=when), float(rng.random() < 0.8)))
    schema = "metric string, series string, eval_ts timestamp_ntz, value double"
    rule = al.Rule("A", "m", ">", 0.5, 60, "warning")
    folder = str(tmp_path / "evals")
    for part in range(6):
        piece = al.apply_rules(spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema), [rule])
        piece.coalesce(1).write.parquet(f"{folder}/part={part}")
    evals = al.apply_rules(spark.createDataFrame(rows, schema), [rule])
    source = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = drain(spark, folds.stream_alert_states(source, 30), "alerts", tmp_path)
    batch = al.alert_states(evals, 30).withColumn("eval_ts", F.col("eval_ts").cast("timestamp"))
    same(out.select("alertname", "eval_ts", "state"), batch.select("alertname", "eval_ts", "state"))


def test_events_to_alert_states(spark, feed, tmp_path):
    """Events, closed windows as a table, rules, states: two chained streams."""
    folder, rows = feed
    rule = al.Rule("Busy", "rate", ">", 0.05, 120, "warning")

    def evaluations(windows_table):
        samples = windows_table.select(
            F.lit("rate").alias("metric"), F.col("k").alias("series"),
            F.col("window_end").alias("eval_ts"), F.col("rate").alias("value"),
        )
        return al.apply_rules(samples, [rule])

    live = windows.stream_event_rate(stream(spark, folder), "ts", ["k"], 120, 60, "1 minute")
    closed = str(tmp_path / "closed")
    tables.append_stream(live, closed, str(tmp_path / "c1"), True).awaitTermination(300)
    followed = tables.follow_table(spark, closed, live.schema)
    states = folds.stream_alert_states(evaluations(followed), 60)
    out = str(tmp_path / "states")
    tables.append_stream(states, out, str(tmp_path / "c2"), True).awaitTermination(300)
    got = spark.read.parquet(out).select("alertname", "series", "eval_ts", "state")
    batch = al.alert_states(evaluations(spark.read.parquet(closed)), 60)
    assert {r.state for r in got.collect()} == {"inactive", "pending", "firing"}
    same(got, batch.select(got.columns))
    every = mx.event_rate(rows, "ts", ["k"], 120, 60)
    assert 0.9 * every.count() < spark.read.parquet(closed).count() <= every.count()


@pytest.fixture(scope="module")
def shuffled_table(spark, tmp_path_factory):
    """The events in several files that each span the whole time."""
    folder = tmp_path_factory.mktemp("tables")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(5, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["stream_rate_limit", "stream_ttl_cache", "stream_outage_monitor", "stream_event_rate"])
def test_registered_streams_on_any_layout(spark, shuffled_table, name):
    from rankloom.plans import streams

    run = streams.QUERIES[name]
    got = sorted(map(tuple, run(spark, shuffled_table).collect()))
    assert got and got == sorted(map(tuple, run(spark, "/root/testdata/sf0.001").collect()))


def test_slices_in_time_order(spark, feed):
    _, rows = feed
    parts = [[r.ts for r in p.collect()] for p in tables.in_time_order(rows, "ts", 4)]
    assert len(parts) == 4 and sum(map(len, parts)) == 600
    assert all(max(a) < min(b) for a, b in zip(parts, parts[1:]))
    assert [p.count() for p in tables.in_time_order(rows.limit(0), "ts", 4)] == [0]
    assert [p.count() for p in tables.in_time_order(rows, "ts", 1)] == [600]
