"""Running positions and streaks per key that do not gather a key in one task.

A key's rows are cut into time slices of an hour, or shorter ones on request
(``even_slices``). Windows run inside ``(key, slice)``; what a
slice needs from the past comes from one summary row per slice, so a key holding a
large part of the log spreads over as many tasks as it has slices. ``(key, slice)``
is one struct column ``_at``: never null, even for a null key, and shared by the
windows, the summary and the join between them, which need one exchange together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.clock import micros, rows_per_key_slot, slot

SLICE_SECONDS = 3_600
ROWS_PER_SLICE = 5_000_000


def even_slices(rows: DataFrame, ts: str) -> float:
    """A slice length, an hour at most, fit for a key with a third of all rows."""
    crowd = rows_per_key_slot(rows, micros(ts), SLICE_SECONDS * 1_000_000)
    return SLICE_SECONDS / (1 + crowd // ROWS_PER_SLICE)


def _keys_of(key: list[str]) -> list[Column]:
    return [F.col("_at")[k] for k in key]


def streaks(
    rows: DataFrame,
    key: list[str],
    ts: str,
    order: str,
    good: Column,
    slice_seconds: float = SLICE_SECONDS,
) -> DataFrame:
    """Add to every row, counted per key in time order:

    ``position`` from 1; ``island``, the position of the last good row (0 before
    any); ``bad_streak``, bad rows since then up to this one; ``bad_before``, bad
    rows directly before this one; ``good_streak``, the mirror of ``bad_streak``.
    """
    width = round(slice_seconds * 1_000_000)
    sliced = (
        rows.withColumn("_good", good)
        .withColumn("_us", micros(ts))
        .withColumn("_at", F.struct(*key, slot(F.col("_us"), width).alias("_slice")))
    )
    inside = Window.partitionBy("_at").orderBy("_us", order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    is_good, is_bad = F.col("_good"), ~F.col("_good")
    numbered = (
        sliced.withColumn("_rn", F.row_number().over(inside))
        .withColumn("_good_rn", F.max(F.when(is_good, F.col("_rn"))).over(upto))
        .withColumn("_bad_rn", F.max(F.when(is_bad, F.col("_rn"))).over(upto))
        .withColumn("_good_before", F.max(F.when(is_good, F.col("_rn"))).over(before))
    )
    summary = numbered.groupBy("_at").agg(
        F.count("*").alias("_n"),
        F.max(F.when(is_good, F.col("_rn"))).alias("_g"),
        F.max(F.when(is_bad, F.col("_rn"))).alias("_b"),
    )
    along = Window.partitionBy(*_keys_of(key)).orderBy("_at._slice")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(past), F.lit(0))
    carried = summary.withColumn("_offset", offset).select(
        "_at",
        "_offset",
        F.coalesce(F.max(F.col("_offset") + F.col("_g")).over(past), F.lit(0)).alias("_good_pos"),
        F.coalesce(F.max(F.col("_offset") + F.col("_b")).over(past), F.lit(0)).alias("_bad_pos"),
    )
    position = F.col("_offset") + F.col("_rn")
    last_good = F.coalesce(F.col("_offset") + F.col("_good_rn"), F.col("_good_pos"))
    last_bad = F.coalesce(F.col("_offset") + F.col("_bad_rn"), F.col("_bad_pos"))
    good_before = F.coalesce(F.col("_offset") + F.col("_good_before"), F.col("_good_pos"))
    return numbered.join(carried, "_at").select(
        *rows.columns,
        position.alias("position"),
        last_good.alias("island"),
        (position - last_good).alias("bad_streak"),
        (position - 1 - good_before).alias("bad_before"),
        (position - last_bad).alias("good_streak"),
    )


def carry_last(
    rows: DataFrame,
    key: list[str],
    ts: str,
    order: str,
    value: Column,
    name: str,
    exclusive: bool = False,
    slice_seconds: float = SLICE_SECONDS,
) -> DataFrame:
    """Add ``name``: the last non-null ``value`` up to each row of its key.

    ``exclusive`` leaves the row's own value out.
    """
    at = F.struct(F.col("_us").alias("us"), F.col(order).alias("o"))
    return _carry(
        rows, key, ts, order, value, name, -1 if exclusive else 0, slice_seconds,
        lambda c: F.last(c, ignorenulls=True),
        F.max_by("_value", F.when(F.col("_value").isNotNull(), at)),
        F.coalesce,
    )


def running_max(
    rows: DataFrame,
    key: list[str],
    ts: str,
    order: str,
    value: Column,
    name: str,
    slice_seconds: float = SLICE_SECONDS,
) -> DataFrame:
    """Add ``name``: the greatest non-null ``value`` up to each row of its key."""
    return _carry(
        rows, key, ts, order, value, name, 0, slice_seconds, F.max, F.max("_value"), F.greatest
    )


def _carry(
    rows: DataFrame,
    key: list[str],
    ts: str,
    order: str,
    value: Column,
    name: str,
    upto: int,
    slice_seconds: float,
    running: Callable[[str], Column],
    summed: Column,
    joined: Callable[[str, str], Column],
) -> DataFrame:
    width = round(slice_seconds * 1_000_000)
    sliced = (
        rows.withColumn("_value", value)
        .withColumn("_us", micros(ts))
        .withColumn("_at", F.struct(*key, slot(F.col("_us"), width).alias("_slice")))
    )
    inside = (
        Window.partitionBy("_at")
        .orderBy("_us", order)
        .rowsBetween(Window.unboundedPreceding, upto)
    )
    past = (
        Window.partitionBy(*_keys_of(key))
        .orderBy("_at._slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = sliced.withColumn("_seen", running("_value").over(inside))
    carried = (
        sliced.groupBy("_at")
        .agg(summed.alias("_slice_value"))
        .select("_at", running("_slice_value").over(past).alias("_carried"))
    )
    return seen.join(carried, "_at").select(*rows.columns, joined("_seen", "_carried").alias(name))
