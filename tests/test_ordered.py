"""Rows in any order within the watermark: the folds decide what the batch operators decide."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from rankloom.operators import alerts as al
from rankloom.operators import metrics as mx
from rankloom.operators.cache_replay import ttl_replay
from rankloom.operators.limiter import rate_limit
from rankloom.operators.monitor import outage_events
from rankloom.streaming import folds, ordered
from rankloom.streaming.alerting import stream_latency_alerts

T0 = datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp_ntz, id long, ok boolean, v double"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """300 rows in four files, each up to 1000 seconds after its time; a heartbeat; a row without time."""
    ordered.use_rocksdb(spark)
    rng = random.Random(5)
    now, rows = 0, []
    for i in range(300):
        now += rng.choice([0, 1, 7, 30, 400 * (rng.random() < 0.05)])
        rows.append((rng.choice("abc"), at(now), i, rng.random() < 0.6, rng.random() * 3))
    came = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=rng.randrange(1000)), rng.random()))
    folder = str(tmp_path_factory.mktemp("feed"))
    beat = (None, at(now + 20_000), -1, None, None)
    files = [came[:75], came[75:150] + [("a", None, 999, True, 1.0)], came[150:225], came[225:], [beat]]
    for part, piece in enumerate(files):
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/part={part}")
    assert [r[2] for r in came] != sorted(r[2] for r in came)
    return folder, spark.createDataFrame(rows, SCHEMA)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1).parquet(folder)


def drain(spark, df, name, tmp_path):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(name), query


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def kept(query):
    return query.lastProgress["stateOperators"][-1]["numRowsTotal"]


def test_limiter(spark, feed, tmp_path):
    folder, rows = feed
    out, query = drain(spark, ordered.ordered_rate_limit(stream(spark, folder), "k", "ts", "id", 3, 60, "1000 seconds"), "o_limit", tmp_path)
    same(out.select("k", "id", "accepted"), rate_limit(rows, "k", "ts", "id", 3, 60).select("k", "id", "accepted"))
    assert ordered.late_rows(query) == 0
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 5
    assert out.where("k = 'a'").select(F.min("ts")).first()[0] is not None


def test_cache(spark, feed, tmp_path):
    folder, rows = feed
    out, _ = drain(spark, ordered.ordered_ttl_cache(stream(spark, folder), "k", "ts", "id", 45, "1000 seconds"), "o_cache", tmp_path)
    same(out.select("k", "id", "event"), ttl_replay(rows, "k", "ts", "id", 45).select("k", "id", "event"))


def test_keys_of_one_bucket(spark, feed, tmp_path, monkeypatch):
    """Keys that share a state are judged each on their own; bytes and nulls are keys like others."""
    monkeypatch.setattr(ordered, "BUCKETS", 1)
    folder, rows = feed
    named = F.when(F.col("k") != "c", F.col("k").cast("binary")).alias("k")
    live = ordered.ordered_ttl_cache(stream(spark, folder).select(named, "ts", "id"), "k", "ts", "id", 45, "1000 seconds")
    out, _ = drain(spark, live.where("id >= 0"), "o_bucket", tmp_path)
    want = ttl_replay(rows.select(named, "ts", "id"), "k", "ts", "id", 45)
    assert {r.id: (r.k, r.event) for r in out.collect()} == {r.id: (r.k, r.event) for r in want.collect()}
    assert out.count() == want.count() == 300 and out.where("k IS NULL").count() > 50


def test_monitor_with_streaks(spark, feed, tmp_path):
    folder, rows = feed
    live = ordered.ordered_outage_events(stream(spark, folder), "k", "ts", "id", F.col("ok"), 2, 1, (30, 60), watermark="1000 seconds")
    out, _ = drain(spark, live, "o_monitor", tmp_path)
    batch = outage_events(rows, "k", "ts", "id", F.col("ok"), 2, 1, "00:30", "01:00")
    same(out.select("k", "id", "streak", "event"), batch.select("k", "id", "streak", "event"))


def test_alerts_of_windows_in_one_stream(spark, feed, tmp_path):
    folder, rows = feed
    bounds, rule = (0.5, 1.0, 2.0, 3.0), al.Rule("Slow", "latency_p95", ">", 2.7, 200, "warning", "{value}")
    keyed = stream(spark, folder).withColumn("k", F.coalesce("k", F.lit("")))
    live = stream_latency_alerts(keyed, "ts", F.col("v"), bounds, "k", 300, 100, [rule, al.Rule("x", "other", ">", 0, 1, "w")], watermark="1000 seconds")
    out, _ = drain(spark, live, "o_alerts", tmp_path)
    p95 = mx.latency_windows(rows, "ts", F.col("v"), bounds, ["k"], 300, 100)
    samples = p95.select(F.lit("latency_p95").alias("metric"), F.col("k").alias("series"), F.col("window_end").alias("eval_ts"), F.col("quantile").alias("value"))
    batch = al.alert_states(al.apply_rules(samples, [rule]), 100)
    names = ["series", F.col("eval_ts").cast("timestamp").alias("eval_ts"), "state"]
    same(out.select(*names), batch.select(*names))
    assert out.where("state = 'firing'").count() > 0


def test_late_rows_are_counted_and_change_nothing(spark, tmp_path):
    ordered.use_rocksdb(spark)
    folder = str(tmp_path / "late")
    files = [[("a", at(0), 1), ("a", at(5000), 2)], [("b", at(4500), 4)], [("a", at(10), 3), ("a", at(9000), 5), ("c", at(20_000), 6)]]
    for part, piece in enumerate(files):
        rows = [(*r, True, 0.0) for r in piece]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={part}")
    out, query = drain(spark, ordered.ordered_rate_limit(stream(spark, folder), "k", "ts", "id", 1, 100_000, "1000 seconds"), "o_late", tmp_path)
    assert {(r.id, r.accepted) for r in out.collect()} == {(1, True), (2, False), (4, True), (5, False)}
    assert ordered.late_rows(query) == 1


def test_state_goes(spark, feed, tmp_path):
    """Past its window a client has no state; only the heartbeat's row still waits."""
    folder, _ = feed
    _, query = drain(spark, ordered.ordered_rate_limit(stream(spark, folder), "k", "ts", "id", 3, 60, "1000 seconds"), "o_gone", tmp_path)
    _, held = drain(spark, ordered.ordered_rate_limit(stream(spark, folder), "k", "ts", "id", 3, 10**6, "1000 seconds"), "o_held", tmp_path)
    assert kept(query) < kept(held)


@pytest.mark.parametrize("held, us, gone", [((0, 5), 0, True), ((2, 5), 10**15, False)])
def test_hosts_that_are_up_need_no_state(held, us, gone, spark):
    fold = {}

    def catch(rows, key, ts, order, extra, made, watermark):
        fold["made"] = made

    original, ordered.in_order = ordered.in_order, catch
    try:
        ordered.ordered_outage_events(None, "k", "ts", "id", F.lit(True))
    finally:
        ordered.in_order = original
    assert fold["made"].spent(held, us) is gone


class Store:
    """A state handle in memory that counts the values it takes and gives."""

    def __init__(self):
        self.timers, self.values = set(), 0
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def _counted(self, **calls):
        def call(name, f):
            def counted(*args):
                found = f(*args)
                self.values += len(args[0]) if name in ("put", "appendList") else len(found) if name == "get" else 1
                return found

            return counted

        return SimpleNamespace(**{name: call(name, f) for name, f in calls.items()})

    def getValueState(self, name, schema):
        kept = []
        return self._counted(
            exists=lambda: bool(kept), get=lambda: kept[0], clear=kept.clear, update=lambda v: (kept.clear(), kept.append(v))
        )

    def getListState(self, name, schema):
        kept = []
        return self._counted(
            get=lambda: list(kept), put=lambda v: (kept.clear(), kept.extend(v)), clear=kept.clear,
            appendList=kept.extend, appendValue=kept.append,
        )

    def getMapState(self, name, key, value):
        kept = {}
        return self._counted(getValue=kept.get, updateValue=kept.__setitem__, removeKey=kept.pop)


def monitor_of(spark, monkeypatch, watched):
    """The processor of an outage monitor over ``watched`` frames."""
    caught = []
    with monkeypatch.context() as patch:
        patch.setattr(PandasGroupedOpsMixin, "transformWithStateInPandas", lambda self, processor, made, **_: caught.append(processor) or spark.createDataFrame([], made))
        empty = spark.createDataFrame([], SCHEMA)
        ordered.ordered_outage_events(empty, "k", "ts", "id", F.col("ok"), 2, 1, (30, 60), watermark="1000 seconds")
    return caught[0]


def judged(processor, store, frames, cuts):
    """What the processor makes of all ``frames``, the watermark going on to each of ``cuts`` after them."""
    processor.init(store)
    made = list(processor.handleInputRows((0,), iter(frames), None))
    for ms in cuts:
        assert min(store.timers) <= ms
        store.timers.clear()
        made += processor.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: ms), None)
    return made


def test_a_hot_key_costs_the_state_store_little(spark, monkeypatch):
    """Rows wait in batches: the store is asked for a few values, not one for each row, and none is read twice."""
    n, start = 20_000, 1_704_067_200_000_000
    rows = pd.DataFrame({"bucket": 0, "key0": "a", "in_ts": T0, "in0": [start + i * 10**6 for i in range(n)], "in1": range(n), "in2": True})
    store = Store()
    frames = [rows[i : i + 5000] for i in range(0, n, 5000)]
    made = judged(monitor_of(spark, monkeypatch, rows), store, frames, [start // 1000 + 10_000_000, start // 1000 + 30_000_000])
    assert sum(map(len, made)) == n and set(pd.concat(made)["event"]) == {"ok"}
    assert store.values < 100


def test_keys_and_pieces_of_a_bucket(spark, monkeypatch):
    """Keys that are folded in several pieces, and at several times, are judged like in one."""
    monkeypatch.setattr(ordered, "FRAME_ROWS", 7)
    rng = random.Random(3)
    start = 1_704_067_200_000_000
    rows = [(rng.choice(["a", "b", None]), start + rng.randrange(5000) * 10**6, i, rng.choice([True, True, False, False, None])) for i in range(400)]
    frames = [pd.DataFrame([(0, k, T0, us, i, ok) for k, us, i, ok in rows[at : at + 90]], columns=["bucket", "key0", "in_ts", "in0", "in1", "in2"]) for at in range(0, 400, 90)]
    store = Store()
    out = pd.concat(judged(monitor_of(spark, monkeypatch, frames), store, frames, [start // 1000 + s * 1000 for s in (1700, 1750, 9000)]))
    want = {}
    for key in ("a", "b", None):
        mine = sorted((us, i, ok) for k, us, i, ok in rows if k == key)
        _, events = folds._watch(2, 60, (30, 60), True, None, pd.DataFrame({"_us": [r[0] for r in mine], "_ok": [r[2] for r in mine]}))
        want |= {i: (key, us, event) for (us, i, _), event in zip(mine, events)}
    us = out["_ts"].astype("int64") // (1000 if "ns" in str(out["_ts"].dtype) else 1)
    assert dict(zip(out["_order"], zip(out["key0"], us, out["event"]))) == want and len(out) == 400
    assert {"alert", "cooldown", "quiet", "pending", "recovery", "recovery_quiet", "ok"} == set(out["event"])


@pytest.mark.parametrize("cooldown", [0, 1, 30])
@pytest.mark.parametrize("quiet", [None, (30, 60), (1410, 20)])
def test_monitor_of_columns_is_that_of_rows(cooldown, quiet):
    rng = random.Random(7)
    for _ in range(60):
        now, rows, share = 1_704_067_200_000_000, [], rng.choice([0.05, 0.5, 0.95])
        for _ in range(rng.randrange(1, 60)):
            now += rng.choice([0, 10**6, 7 * 10**6, 400 * 10**6, 2000 * 10**6])
            rows.append((now, rng.choice([None, False]) if rng.random() > share else True))
        frame = pd.DataFrame(rows, columns=["_us", "_ok"])
        cut = rng.randrange(len(rows) + 1)
        held, got = None, []
        for piece in (frame[:cut], frame[cut:]):
            if len(piece):
                held, made = ordered._watched(3, cooldown * 60, quiet, True, held, piece)
                got += list(made["event"])
        (fails, alerted), events = folds._watch(3, cooldown * 60, quiet, True, None, frame)
        assert got == events and held == (fails, alerted or None)
