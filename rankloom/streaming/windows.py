"""Streaming rollups of the request log on event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.metrics import bucket_array, bucket_counts, bucket_quantile


def stream_windows(
    events: DataFrame,
    ts: str,
    window_seconds: int,
    step_seconds: int,
    labels: list[str],
    measures: list[Column],
    watermark: str = "10 minutes",
) -> DataFrame:
    """Sliding-window aggregates; the streaming twin of ``windowed``.

    Rows behind the watermark are dropped. In append mode a window appears once
    the watermark has passed its end.
    """
    begin = F.window("_ts", f"{window_seconds} seconds", f"{step_seconds} seconds")
    grouped = (
        events.withColumn("_ts", F.col(ts).cast("timestamp"))
        .withWatermark("_ts", watermark)
        .groupBy(begin.alias("_window"), *labels)
        .agg(*measures)
    )
    rest = [c for c in grouped.columns if c != "_window"]
    return grouped.select(
        F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *rest
    )


def stream_event_rate(
    events: DataFrame,
    ts: str,
    labels: list[str],
    window_seconds: int = 300,
    step_seconds: int = 30,
    watermark: str = "10 minutes",
) -> DataFrame:
    wide = stream_windows(
        events, ts, window_seconds, step_seconds, labels, [F.count("*").alias("increase")], watermark
    )
    return wide.withColumn("rate", F.col("increase") / F.lit(float(window_seconds)))


def stream_latency(
    events: DataFrame,
    ts: str,
    value: Column,
    bounds: tuple[float, ...],
    labels: list[str],
    window_seconds: int = 300,
    step_seconds: int = 30,
    q: float = 0.95,
    watermark: str = "10 minutes",
) -> DataFrame:
    measures = [*bucket_counts(value, bounds), F.sum(value).alias("seconds")]
    wide = stream_windows(events, ts, window_seconds, step_seconds, labels, measures, watermark)
    total = F.col(f"le_{len(bounds)}")
    return wide.select(
        "window_start",
        "window_end",
        *labels,
        total.alias("requests"),
        bucket_quantile(bucket_array(bounds), bounds, q).alias("quantile"),
        F.try_divide(F.col("seconds"), total).alias("mean_seconds"),
    )
