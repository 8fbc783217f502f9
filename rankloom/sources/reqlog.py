"""Request-log columns and the metrics event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import strip
from rankloom.params import Params


def client_key(headers: Column, host: Column) -> Column:
    """Client of a request: proxy header, first forwarded address, host, ``unknown``.

    An empty header counts as absent. ``headers`` is a map with lower-case names.
    """
    direct = F.nullif(headers["cf-connecting-ip"], F.lit(""))
    forwarded = F.nullif(headers["x-forwarded-for"], F.lit(""))
    return F.coalesce(
        strip(direct), strip(F.split(forwarded, ",")[0]), host, F.lit("unknown")
    )


def body_too_large(content_length: Column, max_bytes: int = Params.max_body_bytes) -> Column:
    """True only for a readable length above the limit; others pass."""
    bare = strip(content_length)
    readable = F.rlike(bare, F.lit(r"^[+-]?[0-9]+(_[0-9]+)*$"))
    digits = F.regexp_replace(bare, "[_+]", "").try_cast("decimal(38,0)")
    # More than 38 digits overflow the decimal and are above any limit.
    large = F.coalesce(digits > max_bytes, ~F.startswith(bare, F.lit("-")))
    return F.coalesce(readable & large, F.lit(False))


def with_request_id(requests: DataFrame, started: str, ended: str) -> DataFrame:
    """Add a random ``request_id`` and ``duration_ms``."""
    seconds = F.col(ended).cast("timestamp").cast("double") - F.col(started).cast("timestamp").cast("double")
    return requests.withColumn("request_id", F.uuid()).withColumn("duration_ms", seconds * 1000)


def stage_events(rows: DataFrame, ts: Column, model: Column, seconds: dict[str, Column]) -> DataFrame:
    """One metrics event per stage that ran: ``(ts, stage, model, status, seconds, tokens, collection)``.

    ``rows`` has ``status`` and ``tokens``; a stage without seconds did not run.
    Tokens are booked on the generate stage. A stage ``name/collection`` is an event of
    stage ``name`` with that collection.
    """
    stages = F.array(
        *[
            F.struct(
                F.lit(name.partition("/")[0]).alias("stage"),
                F.lit(name.partition("/")[2] or None).cast("string").alias("collection"),
                value.cast("double").alias("seconds"),
            )
            for name, value in seconds.items()
        ]
    )
    return (
        rows.withColumn("_s", F.explode(F.filter(stages, lambda s: s["seconds"].isNotNull())))
        .select(
            ts.alias("ts"),
            F.col("_s.stage").alias("stage"),
            model.alias("model"),
            "status",
            F.col("_s.seconds").alias("seconds"),
            F.when(F.col("_s.stage") == "generate", F.col("tokens")).alias("tokens"),
            F.col("_s.collection").alias("collection"),
        )
    )


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)
