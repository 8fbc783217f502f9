import math
import random
from collections import OrderedDict, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rankloom.operators import alerts as al
from rankloom.operators import metrics as mx
from rankloom.operators import clock, runs
from rankloom.operators.admission import admit
from rankloom.operators.cache_replay import cache_stats, lru_replay, ttl_replay
from rankloom.operators.limiter import offered_load, rate_limit
from rankloom.operators.monitor import notices, outage_events, probe_ok, probe_state
from rankloom.operators.runs import carry_last, streaks

T0 = datetime(2024, 1, 1)
EVENTS = "k string, ts timestamp_ntz, id long"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def log(spark, rows):
    """Rows ``(key, seconds)`` numbered in time order."""
    rows = sorted(rows, key=lambda r: r[1])
    return spark.createDataFrame([(k, at(s), i) for i, (k, s) in enumerate(rows)], EVENTS)


def random_rows(seed, n, keys, mean_gap):
    """Bursty traffic; one key holds a good third of all rows; many equal times."""
    rng = random.Random(seed)
    now, rows = 0, []
    for _ in range(n):
        now += rng.choice([0, 0, 1, rng.expovariate(1 / mean_gap), 5 * mean_gap * (rng.random() < 0.05)])
        now = round(now)
        rows.append(("hot" if rng.random() < 0.36 else f"k{rng.randrange(keys)}", now))
    return rows


# --- limiter ------------------------------------------------------------------


def limiter_model(rows, limit, window, inclusive=True):
    taken, out = {}, []
    for k, s in sorted(rows, key=lambda r: r[1]):
        held = taken.setdefault(k, deque())
        while held and (s - held[0] > window if inclusive else s - held[0] >= window):
            held.popleft()
        ok = len(held) < limit
        if ok:
            held.append(s)
        out.append(ok)
    return out


@pytest.mark.parametrize("seed,limit,window,inclusive", [
    (1, 1, 30, True), (2, 3, 20, True), (3, 5, 60, False), (4, 1, 10, False), (5, 60, 60, True),
])
@pytest.mark.parametrize("rows_per_round,slots", [(50_000_000, None), (50_000_000, 7), (60, 3)])
def test_admission_equals_model(spark, seed, limit, window, inclusive, rows_per_round, slots):
    rows = random_rows(seed, 700, 6, 4)
    out = admit(
        log(spark, rows), ["k"], "ts", "id", limit, window, inclusive, rows_per_round,
        slots_per_window=slots,
    )
    got = [r.admitted for r in out.orderBy("id").collect()]
    assert got == limiter_model(rows, limit, window, inclusive)


def test_slots_get_narrower_with_density(spark):
    data = log(spark, [("a", s) for s in range(301)])
    assert runs.even_slices(data, "ts") == runs.SLICE_SECONDS
    assert clock.rows_per_key_slot(data, clock.micros("ts"), 30_000_000) == pytest.approx(301 / 3 / 10)
    assert clock.rows_per_key_slot(data.limit(0), clock.micros("ts"), 30_000_000) == 0.0


def test_limiter_edges(spark):
    # 60 s old still counts; refused requests leave no trace.
    rows = [("c", 0), ("c", 1), ("c", 60), ("c", 60.5), ("c", 61), ("c", 61.5)]
    out = rate_limit(log(spark, rows), "k", "ts", "id", 2, 60).orderBy("id").collect()
    assert [r.accepted for r in out] == [True, True, False, True, False, True]
    with pytest.raises(ValueError):
        rate_limit(log(spark, rows), "k", "ts", "id", 0, 60)


def test_limiter_null_client(spark):
    rows = spark.createDataFrame([(None, at(0), 1), (None, at(1), 2), ("a", at(1), 3)], EVENTS)
    out = rate_limit(rows, "k", "ts", "id", 1, 60)
    assert {r.id: r.accepted for r in out.collect()} == {1: True, 2: False, 3: True}
    counted = streaks(rows, ["k"], "ts", "id", F.lit(False)).collect()
    assert {r.id: r.bad_streak for r in counted} == {1: 1, 2: 2, 3: 1}


def test_offered_load(spark):
    out = offered_load(log(spark, [("c", 0), ("c", 10), ("c", 61), ("c", 200)]), "k", "ts", 60)
    assert [(r.requests, r.requests_with_previous) for r in out.orderBy("slot_start").collect()] == [
        (2, 2), (1, 3), (1, 1),
    ]


# --- cache ----------------------------------------------------------------------


def cache_model(rows, entries, ttl):
    cache, out = OrderedDict(), []
    for k, s in sorted(rows, key=lambda r: r[1]):
        event = "miss"
        if k in cache:
            if ttl is not None and s - cache[k] > ttl:
                del cache[k]
                event = "expired"
            else:
                cache.move_to_end(k)
                event = "hit"
        evicted = False
        if event != "hit":
            cache[k] = s
            if len(cache) > entries:
                cache.popitem(last=False)
                evicted = True
        out.append((event, evicted))
    return out, len(cache)


@pytest.mark.parametrize("ttl", [None, 25, 200])
@pytest.mark.parametrize("entries,chunks", [(1, 3), (3, 5), (5, 4), (50, 1)])
def test_cache_replay_equals_model(spark, ttl, entries, chunks):
    rows = random_rows(entries * 7 + chunks, 400, 9, 3)
    out = lru_replay(log(spark, rows), "k", "ts", "id", entries, ttl, chunks=chunks)
    want, size = cache_model(rows, entries, ttl)
    assert [(r.event, r.evicted) for r in out.orderBy("id").collect()] == want
    stats = cache_stats(out, ttl or 0, entries).first()
    assert stats["size"] == size
    assert stats["evicted"] == sum(e for _, e in want)
    assert stats["hit"] == sum(e == "hit" for e, _ in want)


def test_ttl_edges(spark):
    rows = [("a", 0), ("a", 299), ("a", 300), ("a", 300.001), ("a", 600)]
    out = ttl_replay(log(spark, rows), "k", "ts", "id", 300).orderBy("id").collect()
    assert [r.event for r in out] == ["miss", "hit", "hit", "expired", "hit"]


# --- streaks and monitor ---------------------------------------------------------


@pytest.mark.parametrize("slice_seconds", [86_400, 20])
def test_streaks(spark, slice_seconds):
    rows = random_rows(9, 300, 3, 4)
    data = log(spark, rows).withColumn("ok", F.pmod(F.xxhash64("id"), F.lit(3)) > 0)
    out = streaks(data, ["k"], "ts", "id", F.col("ok"), slice_seconds).orderBy("id").collect()
    position, bad, good, island = {}, {}, {}, {}
    for r in out:
        before = bad.get(r.k, 0)
        position[r.k] = position.get(r.k, 0) + 1
        bad[r.k] = 0 if r.ok else before + 1
        good[r.k] = good.get(r.k, 0) + 1 if r.ok else 0
        if r.ok:
            island[r.k] = position[r.k]
        assert (r.position, r.bad_streak, r.bad_before, r.good_streak, r.island) == (
            position[r.k], bad[r.k], before, good[r.k], island.get(r.k, 0)
        )


@pytest.mark.parametrize("exclusive", [False, True])
def test_carry_last(spark, exclusive):
    data = log(spark, random_rows(10, 200, 3, 4)).withColumn(
        "v", F.when(F.pmod(F.xxhash64("id"), F.lit(4)) == 0, F.col("id"))
    )
    out = carry_last(data, ["k"], "ts", "id", F.col("v"), "c", exclusive, 30).orderBy("id").collect()
    held = {}
    for r in out:
        before = held.get(r.k)
        held[r.k] = before if r.v is None else r.v
        assert r.c == (before if exclusive else held[r.k])


def monitor_model(probes, threshold, cooldown, quiet, recovery):
    fails, down, alerted, out = 0, False, 0, []
    for second, ok in probes:
        minute = second // 60 % 1440
        low, high = quiet or (0, 0)
        silent = quiet is not None and (low <= minute < high if low < high else minute >= low or minute < high)
        epoch = second + int((T0 - datetime(1970, 1, 1)).total_seconds())
        if ok:
            event = "ok"
            if down and recovery:
                event = "recovery_quiet" if silent else "recovery"
            fails, down, alerted = 0, False, 0
        else:
            fails, down = fails + 1, True
            if fails < threshold:
                event = "pending"
            elif silent:
                event = "quiet"
            elif epoch - alerted >= cooldown or alerted == 0:
                event, alerted = "alert", epoch
            else:
                event = "cooldown"
        out.append(event)
    return out


@pytest.mark.parametrize("threshold,cooldown,quiet,recovery", [
    (3, 240, None, True), (1, 30, (22 * 60, 6 * 60), True), (2, 15, (0, 8 * 60), False), (3, 0, None, True),
])
def test_monitor_equals_model(spark, threshold, cooldown, quiet, recovery):
    rng = random.Random(threshold * 100 + cooldown)
    rows, models = [], {}
    for host in ("h1", "h2"):
        now, bad = 0, False
        probes = []
        for _ in range(250):
            now += rng.choice([300, 300, 301, 900])
            bad = bad if rng.random() < 0.8 else not bad
            probes.append((now, not bad))
        models[host] = monitor_model(probes, threshold, cooldown * 60, quiet, recovery)
        rows += [(host, at(s), i, ok) for i, (s, ok) in enumerate(probes)]
    data = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, ok boolean")
    hhmm = ["", ""] if quiet is None else [f"{m // 60:02d}:{m % 60:02d}" for m in quiet]
    out = outage_events(data, "k", "ts", "id", F.col("ok"), threshold, cooldown, *hhmm, send_recovery=recovery)
    got = {}
    for r in out.orderBy("k", "id").collect():
        got.setdefault(r.k, []).append(r.event)
    assert got == models
    assert {r.event for r in notices(out, "k", "ts").collect()} <= {"alert", "recovery"}


def test_probe_ok_needs_both(one):
    assert one(probe_ok(F.lit(200), F.lit(200))) is True
    assert one(probe_ok(F.lit(200), F.lit(503))) is False
    assert one(probe_ok(F.lit(None).cast("int"), F.lit(200))) is False


def test_probe_hysteresis(spark):
    pattern = [1, 0, 0, 1, 0, 0, 0, 1, 0, 1, 1, 0]
    data = spark.createDataFrame(
        [("h", at(i * 60), i, bool(b)) for i, b in enumerate(pattern)],
        "k string, ts timestamp_ntz, id long, ok boolean",
    )
    out = probe_state(data, "k", "ts", "id", F.col("ok")).orderBy("id").collect()
    assert [r.state for r in out] == ["up"] * 6 + ["down"] * 4 + ["up"] * 2


# --- metrics -----------------------------------------------------------------------


def test_histogram_edges(spark):
    data = spark.createDataFrame(
        [("a", 0.05), ("a", 0.1), ("a", 0.1000001), ("big", 99.0)], "g string, v double"
    )
    out = mx.histogram(data, F.col("v"), (0.05, 0.1), ["g"]).orderBy("g", "le").collect()
    assert [(r.g, r.le, r.cum_count) for r in out] == [
        ("a", 0.05, 1), ("a", 0.1, 2), ("a", float("inf"), 3),
        ("big", 0.05, 0), ("big", 0.1, 0), ("big", float("inf"), 1),
    ]
    assert out[0].total_count == 3


@pytest.mark.parametrize(
    "counts,q,want",
    [
        ([0, 0, 5], 0.95, 2.0),         # everything in the infinite bucket
        ([0, 0, 0], 0.95, None),        # nothing observed
        ([10, 10, 10], 0.5, 0.5),       # first bucket starts at 0
        ([2, 10, 10], 0.95, 1 + 7.5 / 8),
        ([4, 8, 10], 0.4, 1.0),         # rank on a bound
    ],
)
def test_bucket_quantile(one, counts, q, want):
    got = one(mx.bucket_quantile(F.array(*[F.lit(c) for c in counts]), (1.0, 2.0), q))
    assert got == (pytest.approx(want) if want is not None else None)


def test_windows_cover_each_event_once_per_window(spark):
    data = log(spark, [("a", s) for s in (0, 29, 30, 299, 300)])
    out = mx.windowed(data, "ts", 300, 30, ["k"], [F.count("*").alias("n")])
    native = (
        data.withColumn("t", F.col("ts").cast("timestamp"))
        .groupBy(F.window("t", "300 seconds", "30 seconds").alias("w"), "k").agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "k", "n")
    )
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, native.collect()))
    with pytest.raises(ValueError):
        mx.windowed(data, "ts", 300, 70, [], [])


def test_sampled_rate_restart(spark):
    data = spark.createDataFrame(
        [("s", at(i * 15), i, v) for i, v in enumerate([10, 14, 3, 5])],
        "k string, ts timestamp_ntz, id long, v long",
    )
    out = mx.sampled_rate(data, ["k"], "ts", "id", "v", 60, 60).first()
    assert out.increase == 4 + 3 + 2 and out.rate == 9 / 60


def test_status_matcher_is_whole_string(one):
    assert one(mx.status_matches(F.lit("503"), "5..")) is True
    assert one(mx.status_matches(F.lit("5031"), "5..")) is False


# --- alerts ---------------------------------------------------------------------------


def states(spark, values, rule, step=30, skip=()):
    rows = [
        (rule.metric, "s", at(i * step), float(v)) for i, v in enumerate(values) if i not in skip
    ]
    samples = spark.createDataFrame(rows, "metric string, series string, eval_ts timestamp_ntz, value double")
    out = al.alert_states(al.apply_rules(samples, [rule]), step)
    return [r.state for r in out.orderBy("eval_ts").collect()]


def test_for_duration(spark):
    rule = al.Rule("A", "m", ">", 1.0, 60, "warning")
    p, f, i = "pending", "firing", "inactive"
    assert states(spark, [2, 2, 2, 2, 1, 2, 2], rule) == [p, p, f, f, i, p, p]
    assert states(spark, [2, 2, 2, 2, 2], rule, skip={2}) == [p, p, p, p]
    assert states(spark, [1, 0], al.Rule("U", "m", "==", 0, 0, "critical")) == [i, f]


def test_shipped_rules(spark):
    rows = [("up:api", 0.0), ("error_rate", 0.2), ("latency_p95", 2.0), ("latency_p95", 2.5), ("other", 1.0)]
    data = spark.createDataFrame(
        [(m, str(i), at(0), v) for i, (m, v) in enumerate(rows)],
        "metric string, series string, eval_ts timestamp_ntz, value double",
    )
    out = al.apply_rules(data).where("active").orderBy("series").collect()
    assert [(r.alertname, r.severity) for r in out] == [
        ("RagApiDown", "critical"), ("HighErrorRate", "warning"), ("HighResponseTime", "warning"),
    ]
    assert out[2].description == "95th percentile response time is 2.5s"


def test_inhibition_by_overlap(spark):
    def span(name, severity, a, b):
        return (name, "s", severity, at(a), at(a), at(b))

    data = spark.createDataFrame(
        [
            span("A", "critical", 10, 20), span("A", "warning", 20, 30), span("A", "warning", 21, 30),
            span("A", "warning", 0, 10), span("A", "warning", 0, 9), span("A", "warning", 5, 50),
            span("B", "warning", 10, 20),
        ],
        "alertname string, series string, severity string, active_since timestamp_ntz,"
        "fired_at timestamp_ntz, last_at timestamp_ntz",
    )
    kept = al.inhibit(data).where("severity = 'warning'").collect()
    assert sorted((r.alertname, r.fired_at) for r in kept) == [
        ("A", at(0)), ("A", at(21)), ("B", at(10)),
    ]
    assert al.inhibit(data).where("severity = 'critical'").count() == 1


def test_notifications(spark):
    minute = 60
    day = 9 * 3600  # 09:00, outside the muted time
    rows = []
    for i in range(0, 600):  # five hours, one evaluation per 30 s
        rows.append(("A", "one", at(day + i * 30), at(day)))
        if i >= 20:
            rows.append(("A", "two", at(day + i * 30), at(day + 600)))
    rows += [("A", "one", at(day + 6 * 3600 + i * 30), at(day + 6 * 3600)) for i in range(10)]
    rows += [("N", "x", at(3600 + i * 30), at(3600)) for i in range(20)]
    firing = spark.createDataFrame(
        rows, "alertname string, series string, eval_ts timestamp_ntz, fired_at timestamp_ntz"
    )
    out = al.notifications(firing).orderBy("alertname", "notified_at").collect()
    times = [(r.alertname, r.notified_at, r.reason) for r in out]
    assert times == [
        ("A", at(day + 2 * minute), "first"),
        ("A", at(day + 32 * minute), "changed"),
        ("A", at(day + 272 * minute), "repeat"),
        ("A", at(day + 6 * 3600 + 2 * minute), "first"),
    ]


def test_silences(spark):
    rows = [("HighX", "click", at(5)), ("HighX", "click", at(20)), ("HighXY", "click", at(5)), ("HighX", None, at(5))]
    data = spark.createDataFrame(rows, "alertname string, series string, eval_ts timestamp_ntz")
    quiet = al.Silence({"alertname": "HighX", "series": "c.*"}, str(at(0)), str(at(10)))
    assert al.apply_silences(data, [quiet]).count() == 3
    assert al.apply_silences(data, []).count() == 4


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_exact_quantile(spark, q):
    """The row at the rank, also where a group holds over a million values."""
    n = 1_200_000
    values = spark.range(n).select(
        F.lit("many").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7.0).alias("v")
    )
    few = spark.createDataFrame(
        [("few", float(v)) for v in (5, 1, 1, 3, 9)] + [("one", 2.0), ("none", None), (None, 4.0), (None, None)],
        "k string, v double",
    )
    got = {r.k: r["quantile"] for r in mx.exact_quantile(values.unionByName(few), F.col("v"), q, ["k"]).collect()}
    rank = lambda some: sorted(some)[max(1, math.ceil(q * len(some))) - 1]
    assert got["few"] == rank([5.0, 1.0, 1.0, 3.0, 9.0]) and got["one"] == 2.0 and got[None] == 4.0
    assert "none" not in got
    every = [r.v for r in values.select("v").toLocalIterator(prefetchPartitions=True)] if q == 0.95 else None
    if every:
        assert got["many"] == rank(every)


def test_exact_quantile_beyond_its_bracket(spark, monkeypatch):
    """Poor estimates without any room: the counts show it, and wider brackets follow."""
    monkeypatch.setattr(mx, "BRACKET_PARTS", 30)
    monkeypatch.setattr(mx, "BRACKET_SPREAD", 0)
    rows = spark.range(40_000).select(
        F.expr("CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END").alias("k"),
        (F.pmod(F.xxhash64("id"), F.lit(10**6)) / 3.0).alias("v"),
    )
    values = {}
    for r in rows.collect():
        values.setdefault(r.k, []).append(r.v)
    for q in (0.33, 0.95):
        want = {k: sorted(v)[math.ceil(q * len(v)) - 1] for k, v in values.items()}
        assert {r.k: r["quantile"] for r in mx.exact_quantile(rows, F.col("v"), q, ["k"]).collect()} == want


def test_exact_quantile_without_labels(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    assert [r["quantile"] for r in mx.exact_quantile(rows, F.col("v"), 0.5, []).collect()] == [2.0]
