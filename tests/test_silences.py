import random
import re
from datetime import datetime, timedelta

from rankloom.operators.silences import apply_silence_table

T0 = datetime(2024, 1, 1)
LABELS = ["alertname", "severity", "series"]
ALERTS = "alertname string, severity string, series string, eval_ts timestamp, level int, _start int"
SILENCES = "matchers map<string,string>, starts_at timestamp, ends_at timestamp, comment string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def covered(alert, silence):
    matchers, start, end, _ = silence
    if matchers is None or start is None or alert[3] is None:
        return False
    if not start <= alert[3] < (end or datetime.max):
        return False
    values = dict(zip(LABELS, alert))
    return all(values.get(k) is not None and re.fullmatch(p, values[k]) for k, p in matchers.items())


def check(spark, alerts, silences):
    table = spark.createDataFrame([(*a, 1, 2) for a in alerts], ALERTS).repartition(3)
    got = apply_silence_table(table, spark.createDataFrame(silences, SILENCES), LABELS)
    assert got.columns == table.columns
    want = sorted((a for a in alerts if not any(covered(a, s) for s in silences)), key=repr)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == want
    return len(want)


def test_random_ranges_and_patterns(spark):
    rng = random.Random(2)
    names = ["HighX", "High", "Down", None, "*"]
    alerts = [
        (rng.choice(names), rng.choice(["warning", "critical"]), rng.choice(["click", "view", "c", None]), at(rng.randrange(-9000, 9000) / 4))
        for _ in range(400)
    ]
    alerts += [("High", "warning", "c", None), alerts[0]]
    patterns = [{"alertname": "High"}, {"alertname": "High.*"}, {"severity": "(warning|critical)", "series": "c"}, {"alertname": "Down", "series": "v.*"}, {"absent": ".*"}]
    silences = []
    for k in range(40):
        start = rng.randrange(-3000, 3000)
        silences.append((patterns[k % 5], at(start), at(start + rng.choice([0, 0.001, 1, 15, 16, 17, 300])), "x"))
    silences += [(None, at(0), at(10), ""), ({"alertname": "Down"}, None, None, ""), ({}, at(500.25), at(500.5), "")]
    left = check(spark, alerts, silences)
    assert 50 < left < 390


def test_endless_and_long_ranges(spark):
    alerts = [("High", "warning", "c", at(s)) for s in (-1, 0, 10**6, 10**9)]
    assert check(spark, alerts, [({"alertname": "High"}, at(0), None, "")]) == 1
    assert check(spark, alerts, [({"alertname": "H.*"}, at(0), at(2 * 10**6), "")]) == 2


def test_nothing(spark):
    alerts = [("High", "warning", "c", at(1))]
    assert check(spark, alerts, []) == 1
    assert apply_silence_table(spark.createDataFrame([], ALERTS), spark.createDataFrame([], SILENCES), LABELS).collect() == []


def test_very_many_silences(spark):
    """100,000 silences of one hour, by equality: each meets the alerts of its name and time."""
    silences = spark.range(100_000).selectExpr(
        "map('alertname', concat('A', id % 5000)) AS matchers",
        "timestamp '2024-01-01' + make_dt_interval(0, 0, 0, id * 7) AS starts_at",
        "timestamp '2024-01-01' + make_dt_interval(0, 1, 0, id * 7) AS ends_at",
    )
    alerts = spark.range(2000).selectExpr(
        "concat('A', id % 5000) AS alertname", "'warning' AS severity", "'s' AS series",
        "timestamp '2024-01-01' + make_dt_interval(0, 0, 0, id * 300) AS eval_ts",
    )
    out = apply_silence_table(alerts, silences, LABELS)
    starts = {k: [7 * n for n in range(k, 100_000, 5000)] for k in range(2000)}
    want = {f"A{k}" for k in range(2000) if not any(s <= 300 * k < s + 3600 for s in starts[k])}
    assert {r.alertname for r in out.collect()} == want
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
