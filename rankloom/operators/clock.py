"""Time and key helpers shared by the event operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without time zone."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def slot(us: Column, width_us: int) -> Column:
    """Start of the epoch-aligned slot a point in time falls into."""
    return us - F.pmod(us, F.lit(width_us))


def join_same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal key columns where null equals null, so no key loses its rows.

    The keys are compared as one struct: it is never null itself, and unlike
    ``<=>`` its partitioning can be shared with windows over the same struct.
    """
    rest = [c for c in right.columns if c not in on]
    return (
        left.withColumn("_at", F.struct(*on))
        .join(right.select(F.struct(*on).alias("_at"), *rest), "_at", how)
        .drop("_at")
    )


def rows_per_key_slot(rows: DataFrame, us: Column, width_us: int) -> float:
    """Rows a key with a third of an evenly spread log has per ``width_us``."""
    total, first, last = rows.agg(F.count(us), F.min(us), F.max(us)).first()
    return 0.0 if not total else total / 3 * min(1.0, width_us / max(1, last - first))
