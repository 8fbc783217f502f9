"""Streams that append to tables and streams that follow such tables.

A window rollup and a keyed fold are two stateful steps; the first appends its
closed windows to a table, the second follows that table. Both restart from their
checkpoints, and the table in between can be queried like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def in_time_order(log: DataFrame, ts: str, slices: int) -> Iterator[DataFrame]:
    """A log in ``slices`` parts of about equal size, each later than the one before.

    Rows of one time are in one part; rows without a time are in none. An empty log is
    one empty part.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = [k / slices for k in range(1, slices)]
    found = log.agg(F.percentile_approx(at, cuts).alias("cuts")).first()["cuts"] if cuts else []
    ends = sorted(set(found or []))
    for low, high in zip([None, *ends], [*ends, None]):
        after = F.lit(True) if low is None else at > low
        until = at.isNotNull() if high is None else at <= high
        yield log.where(after & until)


def append_stream(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Start appending an append-mode stream to a Parquet table, exactly once."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def follow_table(
    spark: SparkSession,
    path: str,
    schema: StructType,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Rows of a table as they are appended."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
