"""Keyed stateful streams: limiter, TTL cache, outage monitor, alert states.

Rows of one key in one micro-batch are folded in ``(ts, order)`` order. A row older
than what its key has already seen is passed on with ``late`` set and changes
nothing. Over rows that arrive in order, the results equal the batch operators.
The rows of one key in one micro-batch are sorted in memory; the source's limit per
trigger bounds them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable
from datetime import datetime, timezone
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankloom.operators.admission import admit_sorted
from rankloom.operators.clock import micros
from rankloom.params import Params


def _keyed_fold(
    rows: DataFrame,
    key: list[str],
    ts: str,
    order: str,
    extra: list[Column],
    state_type: str,
    fold: Callable,
    event: T.StructField,
    idle_micros: int | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """Run ``fold(state, us, extras) -> (state, events)`` per key.

    With ``idle_micros`` and ``watermark`` a key's state goes once the watermark is
    that far past its last row.
    """
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        timed = timed.withWatermark(ts, watermark)
    narrow = timed.select(*key, ts, order, micros(ts).alias("_us"), *extra)
    fields = [narrow.schema[c] for c in (*key, ts, order)]
    out = T.StructType([*fields, event, T.StructField("late", T.BooleanType())])
    timeout = (
        GroupStateTimeout.EventTimeTimeout
        if idle_micros is not None and watermark
        else GroupStateTimeout.NoTimeout
    )
    names = [f.name for f in fields]
    step = partial(
        _step, names, order, event.name, fold, idle_micros if watermark else None
    )
    return narrow.groupBy(*key).applyInPandasWithState(
        step, out, f"{state_type}, clock_us long, clock_order string", "append", timeout
    )


def _step(
    names: list[str],
    order: str,
    event: str,
    fold: Callable,
    idle_micros: int | None,
    key: tuple,
    frames: Iterable[pd.DataFrame],
    state: GroupState,
):
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames), ignore_index=True)
    rows = rows.sort_values(["_us", order], ignore_index=True)
    held = state.get if state.exists else None
    clock = held[-2] if held else None
    seen = held[-1] if held else None
    late = pd.Series(False, index=rows.index)
    if clock is not None:
        same = rows["_us"] == clock
        late = (rows["_us"] < clock) | (same & rows[order].map(lambda o: not _after(o, seen)))
    fresh = rows[~late]
    if len(fresh):
        values, events = fold(held[:-2] if held else None, fresh)
        last = fresh.iloc[-1]
        state.update((*values, int(last["_us"]), str(last[order])))
        if idle_micros is not None:
            due = (int(last["_us"]) + idle_micros) // 1000 + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield fresh[names].assign(**{event: events, "late": False})
    if late.any():
        yield rows.loc[late, names].assign(**{event: None, "late": True})


def _after(value, seen: str) -> bool:
    return value > type(value)(seen)


# --- limiter --------------------------------------------------------------------


def stream_rate_limit(
    requests: DataFrame,
    client: str,
    ts: str,
    order: str,
    limit: int = Params.rate_limit,
    window_seconds: float = Params.rate_window_seconds,
    watermark: str | None = None,
) -> DataFrame:
    """``(client, ts, order, accepted, late)``; state is the last accepted times."""
    width = round(window_seconds * 1_000_000)
    return _keyed_fold(
        requests, [client], ts, order, [], "recent array<long>",
        partial(_limit, limit, width), T.StructField("accepted", T.BooleanType()),
        width, watermark,
    )


def _limit(limit: int, width: int, held, rows: pd.DataFrame):
    recent = deque(held[0] if held else [])
    us = rows["_us"].tolist()
    taken = set(admit_sorted(us, 0, len(us), recent, limit, width, True))
    return (list(recent),), [i in taken for i in range(len(us))]


# --- TTL cache ------------------------------------------------------------------


def stream_ttl_cache(
    accesses: DataFrame, key: str, ts: str, order: str, ttl_seconds: float
) -> DataFrame:
    """``(key, ts, order, event, late)`` with miss, hit or expired per access."""
    return _keyed_fold(
        accesses, [key], ts, order, [], "set_us long",
        partial(_ttl, round(ttl_seconds * 1_000_000)), T.StructField("event", T.StringType()),
    )


def _ttl(width: int, held, rows: pd.DataFrame):
    us = rows["_us"].tolist()
    recent = deque(held or [])
    events = ["hit"] * len(us)
    for i in admit_sorted(us, 0, len(us), recent, 1, width, True):
        events[i] = "expired" if held or i > 0 else "miss"
    return (recent[-1],), events


# --- outage monitor -------------------------------------------------------------


def stream_outage_events(
    probes: DataFrame,
    host: str,
    ts: str,
    order: str,
    ok: Column,
    threshold: int = 3,
    cooldown_minutes: int = 240,
    quiet_minutes: tuple[int, int] | None = None,
    send_recovery: bool = True,
) -> DataFrame:
    """``(host, ts, order, event, late)``, the events of ``outage_events``.

    ``quiet_minutes``: start and end as minutes of the UTC day.
    """
    return _keyed_fold(
        probes, [host], ts, order, [ok.alias("_ok")], "fails long, alert_second long",
        partial(_watch, threshold, cooldown_minutes * 60, quiet_minutes, send_recovery),
        T.StructField("event", T.StringType()),
    )


def _is_quiet(us: int, quiet: tuple[int, int] | None) -> bool:
    if quiet is None:
        return False
    at = datetime.fromtimestamp(us // 1_000_000, timezone.utc)
    minute = at.hour * 60 + at.minute
    low, high = quiet
    return low <= minute < high if low < high else minute >= low or minute < high


def _watch(threshold: int, cooldown: int, quiet_range, send_recovery: bool, held, rows: pd.DataFrame):
    fails, alerted = held or (0, 0)
    events = []
    for us, good in zip(rows["_us"].tolist(), rows["_ok"].tolist()):
        quiet = _is_quiet(us, quiet_range)
        second = us // 1_000_000
        if good:
            down = fails > 0 and send_recovery
            events.append(("recovery_quiet" if quiet else "recovery") if down else "ok")
            fails, alerted = 0, 0
            continue
        fails += 1
        if fails < threshold:
            events.append("pending")
        elif quiet:
            events.append("quiet")
        elif alerted and second - alerted < cooldown:
            events.append("cooldown")
        else:
            events.append("alert")
            alerted = second
    return (fails, alerted), events


# --- alert states ---------------------------------------------------------------


def stream_alert_states(evaluations: DataFrame, step_seconds: int) -> DataFrame:
    """``(alertname, severity, series, eval_ts, for_seconds, state, late)``, as ``alert_states``.

    Reads evaluations, for instance the table a window stream appends to.
    """
    return _keyed_fold(
        evaluations, ["alertname", "severity", "series"], "eval_ts", "for_seconds",
        [F.col("active").alias("_active")],
        "since_us long, last_us long",
        partial(_advance, step_seconds * 1_000_000), T.StructField("state", T.StringType()),
    )


def _advance(step: int, held, rows: pd.DataFrame):
    since, last = held or (-1, -1)
    states = []
    for us, active, hold in zip(rows["_us"].tolist(), rows["_active"], rows["for_seconds"]):
        if not active:
            since = -1
            states.append("inactive")
        else:
            if since < 0 or us - last > step:
                since = us
            states.append("firing" if us - since >= hold * 1_000_000 else "pending")
        last = us
    return (since, last), states
