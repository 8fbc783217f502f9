"""Latency alerts as one stream: windows of the log, rules on their quantiles, states of the alerts.

Two stateful steps in one query share one watermark: a window leaves the first when the
watermark has passed its end, and its evaluation waits in the second until that has
seen all windows up to it. No table lies between them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators import alerts as al
from rankloom.operators.metrics import bucket_array, bucket_counts, bucket_quantile
from rankloom.streaming.ordered import ordered_alert_states


def latency_samples(
    events: DataFrame, ts: str, value: Column, bounds: tuple[float, ...], series: str, window_seconds: int,
    step_seconds: int, q: float = 0.95, watermark: str = "10 minutes", metric: str = "latency_p95",
) -> DataFrame:
    """``(metric, series, eval_ts, value)``: a quantile for each series and closed window.

    ``eval_ts`` is the last microsecond of the window, the time that goes on with the watermark.
    """
    begin = F.window("_ts", f"{window_seconds} seconds", f"{step_seconds} seconds")
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    grouped = timed.groupBy(begin.alias("_window"), F.col(series).alias("series")).agg(*bucket_counts(value, bounds))
    return grouped.select(
        F.lit(metric).alias("metric"),
        "series",
        F.window_time("_window").alias("eval_ts"),
        bucket_quantile(bucket_array(bounds), bounds, q).alias("value"),
    )


def stream_latency_alerts(
    events: DataFrame, ts: str, value: Column, bounds: tuple[float, ...], series: str, window_seconds: int,
    step_seconds: int, rules: Iterable[al.Rule], q: float = 0.95, watermark: str = "10 minutes",
) -> DataFrame:
    """``(alertname, severity, series, eval_ts, for_seconds, state)`` of the latency rules, window by window."""
    samples = latency_samples(events, ts, value, bounds, series, window_seconds, step_seconds, q, watermark)
    latency = [rule for rule in rules if rule.metric == "latency_p95"]
    states = ordered_alert_states(al.apply_rules(samples, latency), step_seconds, watermark=None)
    return states.withColumn("eval_ts", F.timestamp_add("MICROSECOND", F.lit(1), F.col("eval_ts")))
