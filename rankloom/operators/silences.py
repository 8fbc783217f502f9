"""Silences as a table: an anti join of alerts with time ranges and label patterns.

A time range is cut into few aligned blocks of 16, 256, ... seconds and an alert lies in one
block of each size, so that ranges are met by equality. A silence that names an alert, and not a
pattern, meets alerts of that name only. What meets is verified to the microsecond and
by the patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.clock import micros

#: Sizes of blocks; the largest have 16^9 seconds, more than two thousand years.
LEVELS = 10
_ANY = "*"


def _blocks() -> Column:
    """The aligned blocks that make up the seconds from ``_a`` to before ``_b``, as ``(level, block)``."""

    def span(low: str, high: str) -> str:
        return f"IF({low} < {high}, sequence({low}, {high} - 1), CAST(array() AS array<bigint>))"

    def ends(level: int) -> tuple[str, str]:
        size = 16**level
        return f"CAST(ceil(_a / {size}D) AS BIGINT)", f"CAST(floor(_b / {size}D) AS BIGINT)"

    each = []
    for level in range(LEVELS):
        low, high = ends(level)
        blocks = span(low, high)
        if level + 1 < LEVELS:  # blocks that a larger one holds are left to it
            inner_low, inner_high = ends(level + 1)
            sides = f"concat({span(low, f'16 * {inner_low}')}, {span(f'16 * {inner_high}', high)})"
            blocks = f"IF({inner_low} < {inner_high}, {sides}, {blocks})"
        each.append(f"transform({blocks}, x -> struct({level} AS level, x AS block))")
    return F.expr(f"concat({', '.join(each)})")


def apply_silence_table(
    alerts: DataFrame, silences: DataFrame, labels: list[str], ts: str = "eval_ts", name: str = "alertname"
) -> DataFrame:
    """The rows of ``alerts`` that no silence covers, with all their columns.

    ``silences`` has ``matchers`` (a map of label to whole-value pattern), ``starts_at`` and
    ``ends_at``, a half-open range. A null end never comes, a null start, null matchers and an empty
    range cover nothing, empty matchers cover every alert of their time. A matcher of a label
    that is not among ``labels``, or is null in an alert, doesn't hold. Alerts without a time are never silenced.
    """
    start, end = micros("starts_at"), F.coalesce(micros("ends_at"), F.lit(253402300800_000000))
    ranged = silences.select("matchers", start.alias("_start"), end.alias("_end"))
    ranged = ranged.where("_start < _end AND matchers IS NOT NULL")
    seconds = ranged.select(
        "*", F.floor(F.col("_start") / 1e6).alias("_a"), F.ceil(F.col("_end") / 1e6).alias("_b"),
        F.col("matchers")[name].alias("_pattern"),
    )
    literal = F.when(F.rlike("_pattern", F.lit("^[A-Za-z0-9_ ]+$")), F.col("_pattern"))
    cut = seconds.select(
        "matchers", "_start", "_end", F.coalesce(literal, F.lit(_ANY)).alias("_name"), F.inline(_blocks())
    ).select("matchers", "_start", "_end", "_name", F.col("level").alias("_level"), F.col("block").alias("_block"))

    own = alerts.select(*labels, micros(ts).alias("_us")).where("_us IS NOT NULL").distinct()
    at = [F.struct(F.lit(k).alias("_level"), F.floor(F.col("_us") / (1e6 * 16**k)).alias("_block")) for k in range(LEVELS)]
    names = F.explode(F.array(F.coalesce(F.col(name), F.lit(_ANY)), F.lit(_ANY))).alias("_name")
    met = own.select("*", F.inline(F.array(*at))).select("*", names).distinct()
    held = F.create_map(*[part for label in labels for part in (F.lit(label), F.col(label).cast("string"))])

    def holds(entry: Column) -> Column:
        whole = F.concat(F.lit("^(?:"), entry["value"], F.lit(")$"))
        return F.coalesce(F.rlike(F.element_at("_labels", entry["key"]), whole), F.lit(False))

    inside = (F.col("_us") >= F.col("_start")) & (F.col("_us") < F.col("_end"))
    found = met.withColumn("_labels", held).join(cut, ["_level", "_block", "_name"]).where(inside)
    covered = found.where(F.forall(F.map_entries("matchers"), holds)).select(*labels, "_us").distinct()
    same = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in labels]
    return alerts.alias("a").join(covered.alias("b"), [*same, micros(F.col(f"a.`{ts}`")) == F.col("b._us")], "left_anti")
