"""Alert evaluation over metric samples on a fixed evaluation grid.

The inputs are evaluations (one row per series and step), not raw events, so the
groups of the windows below grow with covered time only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import in_quiet_hours
from rankloom.operators.admission import group_starts
from rankloom.operators.clock import from_micros, micros
from rankloom.operators.runs import running_max


@dataclass(frozen=True)
class Rule:
    """``metric op threshold`` held ``for_seconds``; the description may use {value}."""

    alertname: str
    metric: str
    op: str
    threshold: float
    for_seconds: int
    severity: str
    description: str = ""


# The shipped rules.
RULES = (
    Rule("RagApiDown", "up:api", "==", 0, 120, "critical", "RAG API has been down for more than 2 minutes"),
    Rule("HighErrorRate", "error_rate", ">", 0.1, 300, "warning", "Error rate is {value} errors/sec for the last 5 minutes"),
    Rule("HighResponseTime", "latency_p95", ">", 2.0, 300, "warning", "95th percentile response time is {value}s"),
    Rule("QdrantDown", "up:store", "==", 0, 120, "critical", "Qdrant has been unreachable for more than 2 minutes"),
    Rule("PrometheusDown", "up:metrics", "==", 0, 300, "critical", "Prometheus is not scraping itself"),
)


def _holds(rule: Rule, value: Column) -> Column:
    compare = {
        ">": value > rule.threshold,
        ">=": value >= rule.threshold,
        "<": value < rule.threshold,
        "<=": value <= rule.threshold,
        "==": value == rule.threshold,
    }
    return F.coalesce(compare[rule.op], F.lit(False))


def _render(rule: Rule) -> Column:
    before, found, after = rule.description.partition("{value}")
    if not found:
        return F.lit(before)
    return F.concat(F.lit(before), F.col("value").cast("string"), F.lit(after))


def apply_rules(samples: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """Evaluate rules on ``(metric, series, eval_ts, value)``.

    One pass: the rules that match a sample's metric are an array expression.
    """

    def judged(rule: Rule) -> Column:
        return F.when(
            F.col("metric") == rule.metric,
            F.struct(
                F.lit(rule.alertname).alias("alertname"),
                F.lit(rule.severity).alias("severity"),
                F.lit(rule.for_seconds).alias("for_seconds"),
                _holds(rule, F.col("value")).alias("active"),
                _render(rule).alias("description"),
            ),
        )

    each = F.explode(F.array_compact(F.array(*[judged(r) for r in rules])))
    return samples.withColumn("rule", each).select(
        "rule.alertname", "series", "eval_ts", "value", "rule.severity", "rule.for_seconds",
        "rule.active", "rule.description",
    )


def alert_states(evaluations: DataFrame, step_seconds: int) -> DataFrame:
    """Add ``state`` (inactive, pending, firing) and ``active_since``.

    An alert fires once its condition held at every evaluation for
    ``for_seconds``; a missing evaluation ends the stretch like a false one.
    """
    step = step_seconds * 1_000_000
    alert = ["alertname", "severity", "series"]
    series = Window.partitionBy(*alert).orderBy("_us")
    broken = (
        ~F.col("active")
        | F.coalesce(~F.lag("active").over(series), F.lit(True))
        | F.coalesce(F.col("_us") - F.lag("_us").over(series) > step, F.lit(True))
    )
    stretch = F.sum(F.col("_broken").cast("int")).over(series)
    held = Window.partitionBy(*alert, "_stretch")
    timed = (
        evaluations.withColumn("_us", micros("eval_ts"))
        .withColumn("_broken", broken)
        .withColumn("_stretch", stretch)
        .withColumn("_since", F.when(F.col("active"), F.min("_us").over(held)))
    )
    return timed.select(
        *evaluations.columns,
        F.when(~F.col("active"), F.lit("inactive"))
        .when(F.col("_us") - F.col("_since") >= F.col("for_seconds").cast("long") * 1_000_000, F.lit("firing"))
        .otherwise(F.lit("pending"))
        .alias("state"),
        from_micros(F.col("_since")).alias("active_since"),
    )


def firing_intervals(states: DataFrame) -> DataFrame:
    """Firing stretches ``(alertname, series, severity, active_since, fired_at, last_at)``."""
    return (
        states.where("state = 'firing'")
        .groupBy("alertname", "series", "severity", "active_since")
        .agg(F.min("eval_ts").alias("fired_at"), F.max("eval_ts").alias("last_at"))
    )


def inhibit(intervals: DataFrame, source: str = "critical", target: str = "warning") -> DataFrame:
    """Drop ``target`` intervals that overlap a ``source`` interval of the same alertname.

    A source interval overlaps iff, of those starting by the target's end, one
    ends at or after the target's start. A running maximum finds that without
    pairing the intervals, and without gathering an alertname in one task.
    """
    is_source = F.col("severity") == source
    swept = intervals.withColumn(
        "_point", F.when(is_source, F.col("fired_at")).otherwise(F.col("last_at"))
    ).withColumn("_turn", F.when(is_source, 0).otherwise(1))
    reach = running_max(
        swept, ["alertname"], "_point", "_turn", F.when(is_source, F.col("last_at")), "_reach"
    )
    covered = F.coalesce(F.col("_reach") >= F.col("fired_at"), F.lit(False))
    return reach.where(~((F.col("severity") == target) & covered)).drop("_point", "_turn", "_reach")


def muted(ts: Column, start: str = "00:00", end: str = "08:00") -> Column:
    return in_quiet_hours(ts, start, end)


@dataclass(frozen=True)
class Silence:
    """Label patterns (whole-value regular expressions) and a half-open time range."""

    matchers: dict[str, str]
    starts_at: str
    ends_at: str


def apply_silences(alerts: DataFrame, silences: Iterable[Silence], ts: str = "eval_ts") -> DataFrame:
    """Rows no silence covers. Silences are configuration and become one predicate."""

    def covers(silence: Silence) -> Column:
        at = F.col(ts).cast("timestamp")
        during = (at >= F.lit(silence.starts_at).cast("timestamp")) & (
            at < F.lit(silence.ends_at).cast("timestamp")
        )
        matched = [
            F.coalesce(F.rlike(F.col(label), F.lit(f"^(?:{pattern})$")), F.lit(False))
            for label, pattern in silence.matchers.items()
        ]
        return reduce(lambda a, b: a & b, matched, during)

    return alerts.where(~reduce(lambda a, b: a | b, map(covers, silences), F.lit(False)))


def notifications(
    firing: DataFrame,
    group_wait_seconds: int = 120,
    group_interval_seconds: int = 1800,
    repeat_seconds: int = 14400,
    mute_start: str = "00:00",
    mute_end: str = "08:00",
) -> DataFrame:
    """``(alertname, notified_at, reason, alerts)`` from firing evaluations.

    Input ``(alertname, series, eval_ts, fired_at)``, grouped by alertname. The
    first message of a group waits ``group_wait``; a newly firing alert joins
    after ``group_interval`` since the last message; unchanged groups repeat
    after ``repeat``. Muted times send nothing. A group with no firing alert at an
    evaluation starts over.
    """
    groups = firing.groupBy("alertname", micros("eval_ts").alias("us")).agg(
        F.min(micros("fired_at")).alias("oldest"),
        F.max(micros("fired_at")).alias("newest"),
        F.count("*").alias("alerts"),
    )
    along = Window.partitionBy("alertname").orderBy("us")
    quiet = muted(from_micros(F.col("us")), mute_start, mute_end)
    ready = groups.withColumn("muted", quiet).withColumn("before", F.lag("us").over(along))
    schema = T.StructType(
        [*ready.schema.fields, T.StructField("reason", T.StringType())]
    )
    waits = (group_wait_seconds, group_interval_seconds, repeat_seconds)
    sent = (
        ready.repartition("alertname")
        .sortWithinPartitions("alertname", "us")
        .mapInArrow(partial(_send, [w * 1_000_000 for w in waits]), schema)
    )
    return sent.where("reason IS NOT NULL").select(
        "alertname", from_micros(F.col("us")).alias("notified_at"), "reason", "alerts"
    )


def _send(waits: list[int], batches: Iterable[pa.RecordBatch]):
    wait, interval, repeat = waits
    name, told = None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = batch.to_pylist()
        starts = set(group_starts(batch, ["alertname"]))
        reasons = []
        for i, row in enumerate(rows):
            if (i in starts and row["alertname"] != name) or row["oldest"] > (row["before"] or 0):
                # Another group, or every alert of this one fired after its last
                # evaluation: the earlier incident is over.
                told = None
            name = row["alertname"]
            reason = None
            if not row["muted"]:
                if told is None:
                    reason = "first" if row["us"] - row["oldest"] >= wait else None
                elif row["us"] - told >= repeat:
                    reason = "repeat"
                elif row["newest"] > told and row["us"] - told >= interval:
                    reason = "changed"
            if reason:
                told = row["us"]
            reasons.append(reason)
        yield batch.append_column("reason", pa.array(reasons, pa.string()))
