"""Greedy spaced admission: the recursion behind limiter, TTL cache and cooldowns.

Per key and in time order an event is admitted when fewer than ``limit`` events
admitted before it are still inside the window. Only admitted events count, so
this is a recursion and no window frame expresses it. What can be decided without
the recursion is decided by plain aggregation:

* time is cut into slots, one or more per window. Where a slot and the slots a
  window back together hold at most ``limit`` events, every event of the slot is
  admitted ("calm");
* after a window of calm slots the state is known without looking further back, so
  busy slots less than a window apart form a chain of their own. Chains, not keys,
  are what is distributed, seeded with the calm slots before them;
* a chain longer than ``rows_per_round`` is cut at slot borders. Round ``r``
  folds the r-th piece of all chains in parallel and hands the last ``limit``
  admitted events to round ``r + 1`` through the checkpoint folder, so no task
  ever reads an unbounded stretch of a hot key.

Inside a piece the fold jumps from admission to admission by binary search.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterable
from functools import partial, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.clock import join_same, micros, rows_per_key_slot, slot
from rankloom.session import settle, settle_by

ROWS_PER_ROUND = 50_000_000
ROWS_PER_SLOT = 5_000_000
MOST_SLOTS = 1024


def admit(
    events: DataFrame,
    key: list[str],
    ts: str,
    order: str,
    limit: int,
    window_seconds: float,
    inclusive: bool = True,
    rows_per_round: int = ROWS_PER_ROUND,
    carry: list[str] | None = None,
    slots_per_window: int | None = None,
) -> DataFrame:
    """``(*key, ts, order, *carry, admitted)`` for every event.

    ``events`` is read four times; pass a table or a settled frame. By default the
    slots are made narrow enough for a key with a third of all rows.
    ``inclusive``: an admitted event exactly ``window_seconds`` old still counts.
    Events of equal time are taken in the order of the unique column ``order``.
    """
    width = round(window_seconds * 1_000_000)
    columns = [*key, ts, order, *(carry or [])]
    timed = events.select(*columns, micros(ts).alias("us"))
    if slots_per_window is None:
        crowd = rows_per_key_slot(timed, F.col("us"), width)
        slots_per_window = int(min(MOST_SLOTS, 1 + crowd // ROWS_PER_SLOT))
    slot_width = max(1, -(-width // slots_per_window))
    rows = timed.withColumn("slot", slot(F.col("us"), slot_width))
    busy = settle(
        _busy_slots(rows, key, limit, slot_width, slots_per_window, rows_per_round)
    )
    calm = (
        join_same(rows, busy.where(~F.col("seed")).select(*key, "slot"), [*key, "slot"], "left_anti")
        .select(*columns)
        .withColumn("admitted", F.lit(True))
    )
    chained = join_same(rows, busy, [*key, "slot"])
    folded = _fold_rounds(chained, busy, key, order, limit, width, inclusive)
    return calm.unionByName(folded.select(*columns, "admitted"))


def _busy_slots(
    rows: DataFrame, key: list[str], limit: int, slot_width: int, slots: int, rows_per_round: int
) -> DataFrame:
    """Slots that need the fold: ``(*key, slot, run, seed, piece)``.

    One row per key and slot enters the windows here, so their groups grow with
    the covered time and not with the number of events.
    """
    reach = slots * slot_width
    along = Window.partitionBy(*key).orderBy("slot")
    back = along.rangeBetween(-reach, 0)
    behind, ahead = along.rangeBetween(-reach, -1), along.rangeBetween(1, reach)
    busy = F.col("busy")
    marked = (
        rows.groupBy(*key, "slot")
        .agg(F.count("*").alias("n"))
        .withColumn("busy", F.sum("n").over(back) > limit)
        .withColumn("opens", busy & ~F.coalesce(F.max("busy").over(behind), F.lit(False)))
        # Whether the next busy slot within a window opens a chain; null without one.
        .withColumn("leads", F.first(F.when(busy, F.col("opens")), ignorenulls=True).over(ahead))
        .withColumn("seed", ~busy & F.coalesce("leads", F.lit(False)))
        .withColumn("run", F.sum(F.col("opens").cast("int")).over(along) + F.col("seed").cast("int"))
        .where(busy | F.col("leads").isNotNull())
    )
    chain = Window.partitionBy(*key, "run").orderBy("slot")
    piece = F.floor((F.sum("n").over(chain) - F.col("n")) / F.lit(rows_per_round)).cast("int")
    return marked.select(*key, "slot", "run", "seed", piece.alias("piece"))


def _fold_rounds(
    chained: DataFrame,
    busy: DataFrame,
    key: list[str],
    order: str,
    limit: int,
    width: int,
    inclusive: bool,
) -> DataFrame:
    schema = T.StructType([*chained.schema.fields, T.StructField("admitted", T.BooleanType())])
    chain = [*key, "run"]

    def fold(rows: DataFrame) -> DataFrame:
        return (
            rows.select(chained.columns)
            .repartition(*chain)
            .sortWithinPartitions(*chain, "us", order)
            .mapInArrow(partial(_fold_chains, chain, limit, width, inclusive), schema)
        )

    rounds = (busy.agg(F.max("piece")).first()[0] or 0) + 1
    if rounds == 1:
        return fold(chained)
    pieces = settle_by(chained, "piece")
    newest = Window.partitionBy(*chain).orderBy(F.desc("us"), F.desc(order))
    done: list[DataFrame] = []
    handed = None
    for r in range(rounds):
        rows = pieces.where(F.col("piece") == r)
        if handed is not None:
            rows = rows.unionByName(handed)
        done.append(settle(fold(rows)))
        # The state of a chain is its last admitted events, leading seeds included.
        held = done[-1].where("admitted").drop("admitted").unionByName(rows.where("seed"))
        handed = (
            held.withColumn("seed", F.lit(True))
            .withColumn("place", F.row_number().over(newest))
            .where(F.col("place") <= limit)
            .drop("place")
        )
        handed = settle(handed)
    return reduce(DataFrame.unionByName, done)


# --- task side ---------------------------------------------------------------


def admit_sorted(
    us: list[int],
    start: int,
    stop: int,
    recent: deque,
    limit: int,
    width: int,
    inclusive: bool,
) -> list[int]:
    """Positions admitted among the ascending ``us[start:stop]``.

    ``recent`` holds the last ``limit`` admitted times and is updated.
    """
    seek = bisect_right if inclusive else bisect_left
    admitted = []
    i = start
    while i < stop:
        if len(recent) == limit:
            i = seek(us, recent[0] + width, i, stop)
            if i == stop:
                break
        admitted.append(i)
        recent.append(us[i])
        if len(recent) > limit:
            recent.popleft()
        i += 1
    return admitted


def group_starts(batch: pa.RecordBatch, columns: list[str]) -> list[int]:
    """Positions where a new group begins in a batch sorted by ``columns``."""
    n = batch.num_rows
    changed = None
    for name in columns:
        column = batch.column(name)
        left, right = column.slice(0, n - 1), column.slice(1)
        differs = pc.fill_null(pc.not_equal(left, right), False)
        differs = pc.or_(differs, pc.xor(pc.is_null(left), pc.is_null(right)))
        changed = differs if changed is None else pc.or_(changed, differs)
    return [0, *(i + 1 for i in pc.indices_nonzero(changed).to_pylist())]


def _fold_chains(
    chain: list[str], limit: int, width: int, inclusive: bool, batches: Iterable[pa.RecordBatch]
):
    current, recent = None, deque()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        us = batch.column("us").to_pylist()
        seeds = batch.column("seed").to_pylist()
        verdict = [False] * len(us)
        starts = group_starts(batch, chain)
        for at, stop in zip(starts, [*starts[1:], len(us)]):
            if at > 0 or _head(batch, chain) != current:
                recent = deque()
            while at < stop and seeds[at]:
                recent.append(us[at])
                if len(recent) > limit:
                    recent.popleft()
                at += 1
            for i in admit_sorted(us, at, stop, recent, limit, width, inclusive):
                verdict[i] = True
        current = _head(batch.slice(len(us) - 1), chain)
        decided = batch.append_column("admitted", pa.array(verdict))
        yield decided.filter(pc.invert(batch.column("seed")))


def _head(batch: pa.RecordBatch, columns: list[str]) -> tuple:
    return tuple(batch.column(c)[0].as_py() for c in columns)
