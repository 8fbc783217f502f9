"""Alert queries: rule evaluation, states, inhibition, muting, notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import alerts as al
from rankloom.operators import metrics as mx
from rankloom.operators.silences import apply_silence_table
from rankloom.plans import requests as rq
from rankloom.plans import tables as tb

HOUR = 3600
# Thresholds and times that bind at the tables' event density, one evaluation an hour.
RULES = (
    al.Rule("HighResponseTime", "latency_p95", ">", 1.7, 2 * HOUR, "warning", "p95 is {value}s"),
    al.Rule("HighResponseTime", "latency_p95", ">", 1.9, 1 * HOUR, "critical", "p95 is {value}s"),
    al.Rule("HighErrorRate", "error_pct", ">", 22.0, 3 * HOUR, "warning", "{value} percent of requests fail"),
)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """One value per metric, series and hour: p95 per event type, error share overall."""
    log = tb.request_log(spark, d)
    p95 = mx.latency_windows(
        log, "ts", F.col("seconds"), rq.BOUNDS, ["event_type"], rq.WINDOW, rq.STEP
    ).select(
        F.lit("latency_p95").alias("metric"),
        F.col("event_type").alias("series"),
        F.col("window_end").alias("eval_ts"),
        F.col("quantile").alias("value"),
    )
    errors = mx.error_ratio(log, "ts", F.col("failed"), rq.WINDOW, rq.STEP).select(
        F.lit("error_pct").alias("metric"),
        F.lit("all").alias("series"),
        F.col("window_end").alias("eval_ts"),
        F.col("error_pct").alias("value"),
    )
    return p95.unionByName(errors)


def _states(spark: SparkSession, d: str) -> DataFrame:
    return al.alert_states(al.apply_rules(_samples(spark, d), RULES), rq.STEP)


def _naive(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, tb.naive(name))
    return df


def rule_evaluations(spark: SparkSession, d: str) -> DataFrame:
    out = al.apply_rules(_samples(spark, d), RULES).where("active")
    return _naive(out, "eval_ts").select("alertname", "severity", "series", "eval_ts", "value")


def sustained_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _naive(_states(spark, d), "eval_ts", "active_since").select(
        "alertname", "severity", "series", "eval_ts", "state", "active_since"
    )


def alert_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Messages of all alerts with the value to three places."""
    rounded = _samples(spark, d).withColumn("value", F.round("value", 3))
    states = al.alert_states(al.apply_rules(rounded, RULES), rq.STEP).where("state = 'firing'")
    return _naive(states, "eval_ts").select("alertname", "severity", "series", "eval_ts", "description")


def firing_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _naive(al.firing_intervals(_states(spark, d)), "active_since", "fired_at", "last_at")


def inhibited_alerts(spark: SparkSession, d: str) -> DataFrame:
    kept = al.inhibit(al.firing_intervals(_states(spark, d)))
    return _naive(kept, "fired_at", "last_at").select(
        "alertname", "severity", "series", "fired_at", "last_at"
    )


def muted_alerts(spark: SparkSession, d: str) -> DataFrame:
    heard = _states(spark, d).where("state = 'firing'").where(~al.muted(F.col("eval_ts")))
    return _naive(heard, "eval_ts").select("alertname", "severity", "series", "eval_ts")


SILENCES = (
    al.Silence({"alertname": "HighResponseTime", "series": "(click|view)"}, "2024-01-05", "2024-01-12"),
    al.Silence({"severity": "(warning|critical)"}, "2024-01-20 06:00:00", "2024-01-21 06:00:00"),
)


def silenced_alerts(spark: SparkSession, d: str) -> DataFrame:
    rows = [(s.matchers, s.starts_at, s.ends_at) for s in SILENCES]
    silences = spark.createDataFrame(rows, "matchers map<string,string>, starts_at string, ends_at string")
    firing = _states(spark, d).where("state = 'firing'")
    heard = apply_silence_table(firing, silences, ["alertname", "severity", "series"])
    return _naive(heard, "eval_ts").select("alertname", "severity", "series", "eval_ts")


def alert_notifications(spark: SparkSession, d: str) -> DataFrame:
    firing = _states(spark, d).where("state = 'firing'").withColumn(
        "fired_at", F.col("active_since") + F.make_dt_interval(secs=F.col("for_seconds"))
    )
    out = al.notifications(firing, HOUR, 2 * HOUR, 5 * HOUR)
    return _naive(out, "notified_at")


QUERIES = {
    "rule_evaluations": rule_evaluations,
    "sustained_alerts": sustained_alerts,
    "alert_descriptions": alert_descriptions,
    "firing_intervals": firing_intervals,
    "inhibited_alerts": inhibited_alerts,
    "muted_alerts": muted_alerts,
    "silenced_alerts": silenced_alerts,
    "alert_notifications": alert_notifications,
}


# --- the same in SQL ----------------------------------------------------------


def _evaluations_sql(rounding: str = "") -> str:
    value = f"round(error_pct, {rounding})" if rounding else "error_pct"
    p95 = f"round(p95, {rounding})" if rounding else "p95"
    rules = ", ".join(
        f"('{r.alertname}', '{r.metric}', {r.threshold}::DOUBLE, {r.for_seconds}, '{r.severity}')"
        for r in RULES
    )
    return f"""
    samples AS (
        SELECT 'latency_p95' AS metric, event_type AS series, window_end AS eval_ts, {p95} AS value
        FROM ({rq.SQL["latency_p95"]})
        UNION ALL
        SELECT 'error_pct', 'all', window_end, {value} FROM ({rq.SQL["error_ratio"]})),
    evals AS (SELECT alertname, severity, series, eval_ts, value, hold, value > threshold AS active
              FROM samples JOIN (VALUES {rules}) r(alertname, metric, threshold, hold, severity)
              USING (metric))"""


_STATES = """
    x AS (SELECT *, lag(active) OVER s AS was, lag(eval_ts) OVER s AS before FROM evals
          WINDOW s AS (PARTITION BY alertname, severity, series ORDER BY eval_ts)),
    y AS (SELECT *, count_if(NOT active OR was IS NOT TRUE OR eval_ts - before > INTERVAL 1 HOUR)
          OVER (PARTITION BY alertname, severity, series ORDER BY eval_ts) AS stretch FROM x),
    z AS (SELECT *, CASE WHEN active THEN min(eval_ts) OVER
          (PARTITION BY alertname, severity, series, stretch) END AS active_since FROM y),
    states AS (SELECT alertname, severity, series, eval_ts, value, hold, active_since,
          CASE WHEN NOT active THEN 'inactive'
               WHEN epoch_us(eval_ts) - epoch_us(active_since) >= hold::BIGINT * 1000000 THEN 'firing'
               ELSE 'pending' END AS state FROM z),
    firing AS (SELECT *, active_since + to_seconds(hold) AS fired_at FROM states
               WHERE state = 'firing'),
    spans AS (SELECT alertname, series, severity, active_since, min(eval_ts) AS fired_at,
                     max(eval_ts) AS last_at FROM firing GROUP BY ALL)"""
_HEAD = f"WITH {_evaluations_sql()}, {_STATES}"

SQL = {
    "rule_evaluations": f"""{_HEAD} SELECT alertname, severity, series, eval_ts, value
        FROM evals WHERE active""",
    "sustained_alerts": f"""{_HEAD} SELECT alertname, severity, series, eval_ts, state, active_since
        FROM states""",
    "alert_descriptions": f"""WITH {_evaluations_sql("3")}, {_STATES}
        SELECT alertname, severity, series, eval_ts,
               CASE alertname WHEN 'HighErrorRate' THEN value || ' percent of requests fail'
                    ELSE 'p95 is ' || value || 's' END AS description FROM firing""",
    "firing_intervals": f"{_HEAD} SELECT * FROM spans",
    "inhibited_alerts": f"""{_HEAD} SELECT alertname, severity, series, fired_at, last_at FROM spans t
        WHERE NOT (severity = 'warning' AND EXISTS (SELECT 1 FROM spans c
            WHERE c.severity = 'critical' AND c.alertname = t.alertname
              AND c.fired_at <= t.last_at AND c.last_at >= t.fired_at))""",
    "muted_alerts": f"""{_HEAD} SELECT alertname, severity, series, eval_ts FROM firing
        WHERE extract(hour FROM eval_ts) >= 8""",
    "silenced_alerts": f"""{_HEAD} SELECT alertname, severity, series, eval_ts FROM firing
        WHERE NOT (alertname = 'HighResponseTime' AND series IN ('click', 'view')
                   AND eval_ts >= '2024-01-05' AND eval_ts < '2024-01-12')
          AND NOT (eval_ts >= '2024-01-20 06:00:00' AND eval_ts < '2024-01-21 06:00:00')""",
    "alert_notifications": f"""WITH RECURSIVE {_evaluations_sql()}, {_STATES},
        g AS (SELECT alertname, eval_ts, min(fired_at) AS oldest, max(fired_at) AS newest,
                     count(*) AS alerts, extract(hour FROM eval_ts) < 8 AS muted
              FROM firing GROUP BY alertname, eval_ts),
        o AS (SELECT *, row_number() OVER s AS n, lag(eval_ts) OVER s AS before FROM g
              WINDOW s AS (PARTITION BY alertname ORDER BY eval_ts)),
        k AS (
            SELECT alertname, n, NULL::TIMESTAMP AS told, NULL::VARCHAR AS reason
            FROM (SELECT alertname, 0 AS n FROM o GROUP BY alertname)
            UNION ALL
            SELECT alertname, n, CASE WHEN reason IS NULL THEN held ELSE eval_ts END, reason
            FROM (SELECT *, CASE WHEN muted THEN NULL
                    WHEN held IS NULL THEN CASE WHEN eval_ts - oldest >= INTERVAL 1 HOUR THEN 'first' END
                    WHEN eval_ts - held >= INTERVAL 5 HOUR THEN 'repeat'
                    WHEN newest > held AND eval_ts - held >= INTERVAL 2 HOUR THEN 'changed' END AS reason
                  FROM (SELECT o.*, CASE WHEN o.before IS NULL OR o.oldest > o.before THEN NULL
                               ELSE k.told END AS held
                        FROM k JOIN o ON o.alertname = k.alertname AND o.n = k.n + 1)))
        SELECT alertname, eval_ts AS notified_at, reason, alerts
        FROM k JOIN o USING (alertname, n) WHERE reason IS NOT NULL""",
}
