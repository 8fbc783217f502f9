"""Sliding-window request limiter over a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.admission import admit
from rankloom.operators.clock import micros, slot
from rankloom.params import Params, check_bound


def rate_limit(
    requests: DataFrame,
    client: str,
    ts: str,
    order: str,
    limit: int = Params.rate_limit,
    window_seconds: float = Params.rate_window_seconds,
    **options,
) -> DataFrame:
    """``(client, ts, order, accepted)``: refused requests use up no allowance.

    The allowance is global per client, not per serving process.
    """
    check_bound("rate_limit", limit)
    decided = admit(requests, [client], ts, order, limit, window_seconds, **options)
    return decided.withColumnRenamed("admitted", "accepted")


def offered_load(
    requests: DataFrame, client: str, ts: str, window_seconds: int = Params.rate_window_seconds
) -> DataFrame:
    """Requests per client and slot, with the slot before: an upper bound on any window."""
    width = window_seconds * 1_000_000
    along = Window.partitionBy(client).orderBy("slot")
    sized = requests.groupBy(client, slot(micros(ts), width).alias("slot")).agg(
        F.count("*").alias("requests")
    )
    before = F.when(F.lag("slot").over(along) == F.col("slot") - width, F.lag("requests").over(along))
    return sized.select(
        client,
        F.timestamp_micros("slot").alias("slot_start"),
        "requests",
        (F.col("requests") + F.coalesce(before, F.lit(0))).alias("requests_with_previous"),
    )
