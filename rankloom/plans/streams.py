"""The event operators run as streams over the whole table; same SQL as in batch.

The table is replayed slice by slice: a slice is appended to a folder and the stream,
started anew from its checkpoint, takes it in. Windows read it in time order; keyed folds
read it out of order, each row delayed by up to half a day, in whatever files that makes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.plans import alerting as pa
from rankloom.plans import requests as rq
from rankloom.plans import tables as tb
from rankloom.session import ensure_checkpoint_dir
from rankloom.streaming import ordered, windows
from rankloom.streaming.alerting import stream_latency_alerts as latency_alerts
from rankloom.streaming.tables import append_stream, follow_table, in_time_order

WATERMARK_MINUTES = 10
SLICES = 3
DELAY_HOURS = 12
WAIT = f"{DELAY_HOURS} hours"


def _replayed(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream that ``build`` makes of the events has appended to its table."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    events = tb.table(spark, d, "events")
    for piece in in_time_order(events, "ts", SLICES):
        piece.write.mode("append").parquet(f"{base}/log")
        stream = build(follow_table(spark, f"{base}/log", events.schema))
        append_stream(stream, f"{base}/table", f"{base}/state", available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def _delayed(
    spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], past_seconds: int = 1
) -> DataFrame:
    """What a stream has appended that gets the events out of order, and after them a heartbeat.

    A row comes up to ``DELAY_HOURS`` after its time, so none is behind the watermark of as
    many hours. The heartbeat is a row without key that moves the watermark past all others,
    and ``past_seconds`` further.
    """
    ensure_checkpoint_dir(spark)
    ordered.use_rocksdb(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    events = tb.table(spark, d, "events")
    delay = F.make_dt_interval(secs=F.pmod(F.xxhash64("event_id"), F.lit(DELAY_HOURS * rq.HOUR)))
    beat = events.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL")
    beat = beat.withColumn("ts", F.col("ts") + F.make_dt_interval(hours=F.lit(DELAY_HOURS), secs=F.lit(past_seconds)))
    named = [F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    came = events.withColumn("_came", F.col("ts") + delay)
    for piece in [*in_time_order(came, "_came", SLICES), beat.select(*named)]:
        piece.select(*events.columns).write.mode("append").parquet(f"{base}/log")
        stream = build(follow_table(spark, f"{base}/log", events.schema))
        query = append_stream(stream, f"{base}/table", f"{base}/state", available_now=True)
        query.awaitTermination()
        if ordered.late_rows(query):
            raise RuntimeError("a row came behind the watermark")
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    def limited(log: DataFrame) -> DataFrame:
        return ordered.ordered_rate_limit(log, "event_type", "ts", "event_id", 2, rq.HOUR, WAIT)

    return _delayed(spark, d, limited).withColumn("ts", tb.naive("ts"))


def stream_ttl_cache(spark: SparkSession, d: str) -> DataFrame:
    def cached(log: DataFrame) -> DataFrame:
        return ordered.ordered_ttl_cache(log, "user_id", "ts", "event_id", 6 * rq.HOUR, WAIT)

    return _delayed(spark, d, cached).withColumn("ts", tb.naive("ts"))


def stream_outage_monitor(spark: SparkSession, d: str) -> DataFrame:
    def watched(log: DataFrame) -> DataFrame:
        ok, quiet = F.expr(rq._OK), (22 * 60, 6 * 60)
        return ordered.ordered_outage_events(log, "event_type", "ts", "event_id", ok, 3, 60, quiet, watermark=WAIT)

    return _delayed(spark, d, watched).select("event_type", "event_id", "streak", "event")


def stream_alert_states(spark: SparkSession, d: str) -> DataFrame:
    """States of the latency alerts, from the windows of the same stream."""

    def alerted(log: DataFrame) -> DataFrame:
        # The heartbeat moves the watermark, so it has to come past the filter.
        keyed = log.select(F.coalesce("event_type", F.lit("")).alias("event_type"), "ts", (F.col("value") / 100).alias("seconds"))
        return latency_alerts(keyed, "ts", F.col("seconds"), rq.BOUNDS, "event_type", rq.WINDOW, rq.STEP, pa.RULES, watermark=WAIT)

    out = _delayed(spark, d, alerted, rq.WINDOW + 1)
    return out.where("series != ''").withColumn("eval_ts", tb.naive("eval_ts")).drop("for_seconds")


def stream_latency(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of the windows the watermark has closed."""

    def measured(log: DataFrame) -> DataFrame:
        seconds, patience = F.col("value") / 100, f"{WATERMARK_MINUTES} minutes"
        return windows.stream_latency(log, "ts", seconds, rq.BOUNDS, ["event_type"], rq.WINDOW, rq.STEP, watermark=patience)

    out = _replayed(spark, d, measured).select(
        tb.naive("window_start").alias("window_start"), tb.naive("window_end").alias("window_end"),
        "event_type", "requests", F.col("quantile").alias("p95"),
    )
    return out


def stream_event_rate(spark: SparkSession, d: str) -> DataFrame:
    """Windows the watermark has closed."""

    def rates(log: DataFrame) -> DataFrame:
        patience = f"{WATERMARK_MINUTES} minutes"
        return windows.stream_event_rate(log, "ts", ["event_type"], rq.WINDOW, rq.STEP, patience)

    out = _replayed(spark, d, rates)
    return out.withColumn("window_start", tb.naive("window_start")).withColumn(
        "window_end", tb.naive("window_end")
    )


QUERIES = {
    "stream_rate_limit": stream_rate_limit,
    "stream_ttl_cache": stream_ttl_cache,
    "stream_outage_monitor": stream_outage_monitor,
    "stream_event_rate": stream_event_rate,
    "stream_latency": stream_latency,
    "stream_alert_states": stream_alert_states,
}

# Event times count in milliseconds for the watermark.
_CLOSED = f"""WHERE window_end <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)
                            - INTERVAL {WATERMARK_MINUTES} MINUTE"""

SQL = {
    "stream_rate_limit": rq.SQL["rate_limit"],
    "stream_ttl_cache": rq.SQL["ttl_cache_replay"],
    "stream_outage_monitor": rq.SQL["outage_monitor"],
    "stream_event_rate": f"""SELECT * FROM ({rq.SQL["rate_by_type"]}) {_CLOSED}""",
    "stream_latency": f"""SELECT * FROM ({rq.SQL["latency_p95"]}) {_CLOSED}""",
    # The heartbeat closes the windows that end after the last row, too.
    "stream_alert_states": f"""SELECT alertname, severity, series, eval_ts, state FROM ({pa.SQL["sustained_alerts"]})
        WHERE alertname = 'HighResponseTime'""",
}
