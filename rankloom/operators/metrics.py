"""Counters, histograms, rates and quantiles over a request log.

Every rollup first collapses raw rows to one row per label and time step, with
map-side combining, and only then forms overlapping windows. An event is thus never
multiplied by the number of windows it lies in.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.clock import from_micros, micros, slot
from rankloom.operators.runs import carry_last
from rankloom.session import settle

# Upper bounds of the stage histograms, in seconds.
STAGE_BOUNDS: dict[str, tuple[float, ...]] = {
    "total": (0.05, 0.1, 0.2, 0.5, 1, 2, 5, 10),
    "embed": (0.01, 0.02, 0.05, 0.1, 0.2, 0.5),
    "search": (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1),
    "generate": (0.1, 0.2, 0.5, 1, 2, 5),
}


def counters(events: DataFrame, labels: list[str], amount: Column | None = None) -> DataFrame:
    """Events, and the sum of ``amount``, per label."""
    sums = [] if amount is None else [F.sum(amount).alias("total")]
    return events.groupBy(*labels).agg(F.count("*").alias("events"), *sums)


def bucket_counts(value: Column, bounds: tuple[float, ...]) -> list[Column]:
    """Aggregates ``le_0 .. le_n``: values up to each bound, and all of them last."""
    finite = [F.count_if(value <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return [*finite, F.count(value).alias(f"le_{len(bounds)}")]


def bucket_array(bounds: tuple[float, ...]) -> Column:
    return F.array(*[F.col(f"le_{i}") for i in range(len(bounds) + 1)])


def histogram(
    events: DataFrame, value: Column, bounds: tuple[float, ...], labels: list[str]
) -> DataFrame:
    """Cumulative histogram rows ``(*labels, le, cum_count, total_sum, total_count)``.

    The last bound of each group is infinity. All counts come from one pass.
    """
    wide = events.groupBy(*labels).agg(*bucket_counts(value, bounds), F.sum(value).alias("total_sum"))
    edges = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    pairs = F.arrays_zip(edges.alias("le"), bucket_array(bounds).alias("cum"))
    return wide.withColumn("pair", F.explode(pairs)).select(
        *labels,
        F.col("pair.le").alias("le"),
        F.col("pair.cum").alias("cum_count"),
        "total_sum",
        F.col(f"le_{len(bounds)}").alias("total_count"),
    )


def bucket_quantile(counts: Column, bounds: tuple[float, ...], q: float) -> Column:
    """Quantile from cumulative bucket counts by linear interpolation.

    The first bucket starts at 0. A quantile in the last, infinite bucket is the
    largest finite bound. Null without observations.
    """
    n = len(bounds)
    target = F.element_at(counts, n + 1) * F.lit(q)
    result = F.lit(float(bounds[-1]))
    for i in reversed(range(n)):
        below = F.lit(0) if i == 0 else F.element_at(counts, i)
        low = 0.0 if i == 0 else float(bounds[i - 1])
        width = float(bounds[i]) - low
        inside = F.element_at(counts, i + 1) - below
        # A bucket is reached for the first time here, so it is empty only at rank 0.
        share = F.when(inside > 0, (target - below) / inside).otherwise(F.lit(1.0))
        result = F.when(F.element_at(counts, i + 1) >= target, F.lit(low) + F.lit(width) * share).otherwise(result)
    return F.when(F.element_at(counts, n + 1) > 0, result)


#: Parts of a group within which an estimated quantile lies from the true one.
BRACKET_PARTS = 10_000
#: Such parts between the wanted rank and either end of its bracket, at first.
BRACKET_SPREAD = 2
#: Groups whose brackets, a few numbers each, may be sent to every executor.
SENT_GROUPS = 100_000


def exact_quantile(events: DataFrame, value: Column, q: float, labels: list[str]) -> DataFrame:
    """``(*labels, quantile)``: the least value that at least ``q`` of a group's values reach.

    Estimates bracket the wanted rank. A second pass counts the values below the bracket
    and each value within it, and the rank is found among these: some
    ``1 / BRACKET_PARTS`` of a group. The counts show whether the rank lies in the bracket; groups
    for which it doesn't are looked at again with a wider one, in the end with all their
    values. Null values are left out; a group of nulls has none.
    """
    rows = events.select(*labels, value.alias("_value")).where("_value IS NOT NULL")
    done, spread = None, BRACKET_SPREAD
    while True:
        found = settle(_in_bracket(rows, q, labels, spread / BRACKET_PARTS))
        sure = found.where("_sure").drop("_sure")
        done = sure if done is None else done.unionAll(sure)
        missed = found.where("NOT _sure")
        if missed.isEmpty():
            return done
        spread = 20 * max(spread, 1)
        rows = rows.alias("a").join(missed.alias("b"), _same_group(labels), "left_semi")


def _same_group(labels: list[str]) -> Column:
    """Equal labels in the tables ``a`` and ``b``, null-safe."""
    return reduce(and_, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in labels], F.lit(True))


def _in_bracket(rows: DataFrame, q: float, labels: list[str], spread: float) -> DataFrame:
    """``(*labels, quantile, _sure)``, one row a group: the quantile, if the bracket holds its rank."""
    ends = [max(0.0, q - spread), min(1.0, q + spread)]
    bracket = settle(
        rows.groupBy(*labels).agg(
            F.percentile_approx("_value", ends, BRACKET_PARTS).alias("_ends"),
            F.count("_value").alias("_n"),
        )
    ).where("_n > 0").select(
        *labels,
        F.when(F.lit(ends[0] > 0), F.col("_ends")[0]).alias("_low"),
        F.when(F.lit(ends[1] < 1), F.col("_ends")[1]).alias("_high"),
        F.greatest(F.ceil(F.col("_n") * F.lit(q)), F.lit(1)).alias("_rank"),
    )
    # One row a group: joined null-safe, as a label may be null.
    few = bracket.count() <= SENT_GROUPS
    brackets = F.broadcast(bracket) if few else bracket
    placed = rows.alias("a").join(brackets.alias("b"), _same_group(labels))
    below = F.col("_value") < F.col("_low")
    above = F.col("_value") > F.col("_high")
    # Values outside of the bracket collapse into one count each, before they are shuffled.
    spot = F.when(below, F.lit(None)).otherwise(F.col("_value"))
    counted = (
        placed.where(~F.coalesce(above, F.lit(False)))
        .groupBy(*[F.col(f"a.`{c}`").alias(c) for c in labels], spot.alias("_spot"), "_rank")
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    upto = Window.partitionBy(*labels).orderBy(F.asc_nulls_first("_spot"))
    reached = counted.withColumn("_upto", F.sum("_count").over(upto)).where("_upto >= _rank")
    # The first to reach the rank is a value, or what lies below the bracket, which is null.
    first = reached.groupBy(*labels).agg(F.min_by("_spot", "_upto").alias("quantile"))
    every = bracket.alias("a").join(first.alias("b"), _same_group(labels), "left")
    return every.select(
        *[F.col(f"a.`{c}`").alias(c) for c in labels], "quantile", F.col("quantile").isNotNull().alias("_sure")
    )


def windowed(
    events: DataFrame,
    ts: str,
    window_seconds: int,
    step_seconds: int,
    labels: list[str],
    measures: list[Column],
) -> DataFrame:
    """Sum ``measures`` (aliased aggregates) over sliding windows.

    ``(window_start, window_end, *labels, *measures)`` for windows aligned to the
    epoch that hold at least one event. ``window_seconds`` must be a multiple of
    ``step_seconds``.
    """
    if window_seconds % step_seconds:
        raise ValueError("window_seconds must be a multiple of step_seconds")
    step = step_seconds * 1_000_000
    panes = events.groupBy(*labels, slot(micros(ts), step).alias("_pane")).agg(*measures)
    names = [c for c in panes.columns if c not in labels and c != "_pane"]
    steps = window_seconds // step_seconds
    begin = F.explode(F.sequence(F.col("_pane") - (steps - 1) * step, F.col("_pane"), F.lit(step)))
    summed = (
        panes.withColumn("_begin", begin)
        .groupBy(*labels, "_begin")
        .agg(*[F.sum(n).alias(n) for n in names])
    )
    return summed.select(
        from_micros(F.col("_begin")).alias("window_start"),
        from_micros(F.col("_begin") + window_seconds * 1_000_000).alias("window_end"),
        *labels,
        *names,
    )


def event_rate(
    events: DataFrame,
    ts: str,
    labels: list[str],
    window_seconds: int,
    step_seconds: int,
    amount: Column | None = None,
) -> DataFrame:
    """Events, or the sum of ``amount``, per second and sliding window."""
    measure = F.count("*") if amount is None else F.sum(amount)
    wide = windowed(events, ts, window_seconds, step_seconds, labels, [measure.alias("increase")])
    return wide.withColumn("rate", F.col("increase") / F.lit(float(window_seconds)))


def sampled_rate(
    samples: DataFrame,
    series: list[str],
    ts: str,
    order: str,
    value: str,
    window_seconds: int,
    step_seconds: int,
) -> DataFrame:
    """Rate of sampled counters; a falling sample is a restart and counts in full.

    Each rise is booked at the later of its two samples, so the rise since the last
    sample before a window belongs to the window.
    """
    before = carry_last(samples, series, ts, order, F.col(value), "_before", exclusive=True)
    grown = before.withColumn(
        "_delta",
        F.when(F.col("_before").isNull(), F.lit(None))
        .when(F.col(value) < F.col("_before"), F.col(value))
        .otherwise(F.col(value) - F.col("_before")),
    ).where(F.col("_delta").isNotNull())
    return event_rate(grown, ts, series, window_seconds, step_seconds, F.col("_delta"))


def status_matches(status: Column, pattern: str) -> Column:
    """Label matcher; the pattern must cover the whole value."""
    return F.rlike(status, F.lit(f"^(?:{pattern})$"))


def error_ratio(
    events: DataFrame,
    ts: str,
    failed: Column,
    window_seconds: int,
    step_seconds: int,
    labels: list[str] | None = None,
) -> DataFrame:
    """Failed share of all requests in percent per sliding window."""
    measures = [F.count_if(failed).alias("errors"), F.count("*").alias("requests")]
    wide = windowed(events, ts, window_seconds, step_seconds, labels or [], measures)
    return wide.withColumn(
        "error_pct", F.try_divide(F.lit(100.0) * F.col("errors"), F.col("requests"))
    )


def latency_windows(
    events: DataFrame,
    ts: str,
    value: Column,
    bounds: tuple[float, ...],
    labels: list[str],
    window_seconds: int,
    step_seconds: int,
    q: float = 0.95,
) -> DataFrame:
    """Quantile estimate and mean per sliding window."""
    measures = [*bucket_counts(value, bounds), F.sum(value).alias("seconds")]
    wide = windowed(events, ts, window_seconds, step_seconds, labels, measures)
    total = F.col(f"le_{len(bounds)}")
    return wide.select(
        "window_start",
        "window_end",
        *labels,
        total.alias("requests"),
        bucket_quantile(bucket_array(bounds), bounds, q).alias("quantile"),
        F.try_divide(F.col("seconds"), total).alias("mean_seconds"),
    )


def most_frequent(events: DataFrame, label: str, n: int = 10) -> DataFrame:
    """The ``n`` labels with most rows; ties in label order."""
    return (
        events.groupBy(label).agg(F.count("*").alias("events"))
        .orderBy(F.desc("events"), F.asc(label)).limit(n)
    )


def up_summary(probes: DataFrame, labels: list[str], up: Column, seconds: Column) -> DataFrame:
    """Best state, mean probe duration and number of probes per label."""
    return probes.groupBy(*labels).agg(
        F.max(up.cast("int")).alias("up"),
        F.avg(seconds).alias("mean_seconds"),
        F.count("*").alias("probes"),
    )
