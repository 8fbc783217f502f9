"""Outage monitor over a log of health probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import in_quiet_hours
from rankloom.operators.admission import admit
from rankloom.operators.runs import carry_last, even_slices, streaks
from rankloom.session import settle


def probe_ok(health_code: Column, ready_code: Column, expected: int = 200) -> Column:
    """A probe is good only when both checks return the expected code."""
    return F.coalesce((health_code == expected) & (ready_code == expected), F.lit(False))


def outage_events(
    probes: DataFrame,
    host: str,
    ts: str,
    order: str,
    ok: Column,
    threshold: int = 3,
    cooldown_minutes: int = 240,
    quiet_start: str = "",
    quiet_end: str = "",
    suppress_in_quiet: bool = True,
    send_recovery: bool = True,
    **options,
) -> DataFrame:
    """``(host, ts, order, streak, event)`` for every probe.

    Failing probes: ``pending`` below the threshold, then ``alert``, ``cooldown``
    or ``quiet``. Good probes: ``ok``, or after any failure ``recovery`` /
    ``recovery_quiet``. Quiet hours do not start the cooldown, a good probe ends
    it. Times count in whole seconds.
    """
    quiet = in_quiet_hours(F.col(ts), quiet_start, quiet_end) if suppress_in_quiet else F.lit(False)
    narrow = probes.select(host, ts, order, ok.alias("_ok"))
    runs = streaks(narrow, [host], ts, order, F.col("_ok"), even_slices(probes, ts))
    judged = runs.withColumn(
        "event",
        F.when(
            F.col("_ok"),
            F.when(
                (F.col("bad_before") > 0) & F.lit(send_recovery),
                F.when(quiet, F.lit("recovery_quiet")).otherwise(F.lit("recovery")),
            ).otherwise(F.lit("ok")),
        )
        .when(F.col("bad_streak") < threshold, F.lit("pending"))
        .when(quiet, F.lit("quiet")),
    )
    kept = [host, ts, order, "bad_streak", "event"]
    judged = settle(judged.select(*kept, "island"))
    # The rest wants to alert: per outage, the first one and then one per cooldown.
    wanting = judged.where(F.col("event").isNull()).withColumn(
        "_second", F.date_trunc("second", F.col(ts).cast("timestamp"))
    )
    alerts = admit(
        wanting, [host, "island"], "_second", order, 1, cooldown_minutes * 60,
        inclusive=False, carry=[ts, "bad_streak"], **options,
    ).withColumn("event", F.when(F.col("admitted"), F.lit("alert")).otherwise(F.lit("cooldown")))
    events = judged.where(F.col("event").isNotNull()).select(*kept).unionByName(alerts.select(*kept))
    return events.withColumnRenamed("bad_streak", "streak")


def notices(events: DataFrame, host: str, ts: str) -> DataFrame:
    """The messages a monitor run sends: alerts and recoveries, as JSON text."""
    label = F.when(F.col("event") == "alert", F.lit("ALERT")).otherwise(F.lit("RECOVERY"))
    text = F.concat(
        F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] monitor "), label,
        F.lit(" on "), F.col(host).cast("string"), F.lit(", streak="),
        F.col("streak").cast("string"),
    )
    return events.where(F.col("event").isin("alert", "recovery")).select(
        host, ts, "event", F.to_json(F.struct(text.alias("text"))).alias("message")
    )


def probe_state(
    probes: DataFrame,
    host: str,
    ts: str,
    order: str,
    ok: Column,
    failures_to_down: int = 3,
    successes_to_up: int = 2,
) -> DataFrame:
    """``(host, ts, order, state)``: up or down with hysteresis; hosts start up."""
    narrow = probes.select(host, ts, order, ok.alias("_ok"))
    length = even_slices(probes, ts)
    runs = streaks(narrow, [host], ts, order, F.col("_ok"), length)
    marker = F.when(F.col("bad_streak") >= failures_to_down, F.lit("down")).when(
        F.col("good_streak") >= successes_to_up, F.lit("up")
    )
    marked = carry_last(runs, [host], ts, order, marker, "_state", slice_seconds=length)
    return marked.select(
        host, ts, order, F.coalesce("_state", F.lit("up")).alias("state")
    )
