"""Keyed folds in event-time order: rows may arrive in any order within the watermark.

A row waits in a list state until the watermark has passed it; an event-time timer then folds
all waiting rows that are due, key by key in ``(ts, order)`` order. Keys share states and timers by
hash buckets: what a call to the state store costs is spent on a bucket, not on each key. What the
folds decide is thus what the batch operators decide over the same rows, in whatever order
and files these came. Rows behind the watermark can't be put in order any more: the engine
drops them and counts them (``late_rows``). A fold says when its state tells no more than no
state would; the state then goes, so that keys that are gone take no room.

The waiting rows of a bucket are those of one watermark's delay and one micro-batch; the
source's limit per trigger bounds the latter. They lie in RocksDB as Arrow batches of thousands
of rows: a state store takes and gives values one by one, and a key with a fifth of the log has
as many rows. Batches are numbered values of a map, as a list is read whole for each value
appended to it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rankloom.operators.clock import micros
from rankloom.params import Params
from rankloom.streaming.folds import _advance, _limit, _ttl

#: Keys are dealt to so many buckets, whose rows and states are one read and one write each.
BUCKETS = 512
#: Rows that are folded in one go and go back to Spark as one frame, and of a batch that waits on.
FRAME_ROWS = 50_000
_NEVER = 1 << 50
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams that are started from now on where these folds need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, as far as the query's progress goes back."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


@dataclass(frozen=True)
class Fold:
    """``step(state, rows) -> (state, events)`` over rows in order, and what it keeps.

    ``spent(state, us)`` tells that the state means nothing to rows after a time.
    """

    state: str
    events: str
    step: Callable
    spent: Callable[[tuple, int], bool]


class _InOrder(StatefulProcessor):
    """The keys of one bucket: their waiting rows and their states are each read and put in one go."""

    def __init__(self, fold: Fold, keys: list[str], inside: list[str], held: T.StructType) -> None:
        # Columns arrive numbered: names may clash with the key's, or not be ones Python can say.
        self._fold, self._keys, self._inside, self._held_schema = fold, keys, inside, held
        self._came = [*keys, *(f"in{k}" for k in range(len(inside)))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getMapState("waiting", "part int", "rows binary")
        self._held = handle.getListState("held", self._held_schema)
        # How many parts wait, and the timer that is set.
        self._book = handle.getValueState("book", "parts int, ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts, timer = self._booked()
        times = []
        for frame in rows:
            came = frame[self._came].set_axis([*self._keys, *self._inside], axis=1)
            self._waiting.updateValue((parts,), (_packed(came),))
            parts += 1
            times.append(int(came["_us"].min()))
        self._wake_after(min(times, default=None), parts, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        parts, _ = self._booked()
        many = len(self._keys)
        # A heartbeat may find a bucket without rows, to see whether its states are spent.
        due, later = [], []
        for part in range(parts):
            came = _unpacked(self._waiting.getValue((part,))[0])
            ready = (came["_us"] <= passed).to_numpy()
            if ready.any():
                due.append(came if ready.all() else came[ready])
            if not ready.all():
                later.append(came[~ready])
            self._waiting.removeKey((part,))
        held = {tuple(r[:many]): tuple(_plain(v) for v in r[many:]) for r in self._held.get()}
        parts, wakes = 0, []
        if later:
            rest = pd.concat(later, ignore_index=True)
            for at in _pieces(np.arange(len(rest))):
                self._waiting.updateValue((parts,), (_packed(rest.iloc[at]),))
                parts += 1
            wakes.append(int(rest["_us"].min()))
        if due:
            rows = pd.concat(due, ignore_index=True)
            del due, came
            yield from self._folded(rows, held)
        for name, state in list(held.items()):
            wait = self._patience(state, passed)
            if wait == 0:
                del held[name]
            elif wait < _NEVER:
                wakes.append(passed + wait)
        self._held.clear()
        if held:
            self._held.put([(*name, *state) for name, state in held.items()])
        self._wake_after(min(wakes, default=None), parts)

    def _folded(self, rows: pd.DataFrame, held: dict[tuple, tuple]) -> Iterator[pd.DataFrame]:
        """The events of ``rows``, one key after another; ``held`` gets the keys' new states."""
        place = rows.groupby(self._keys, sort=False, dropna=False).ngroup().to_numpy()
        for at in _pieces(_order_of(place, rows)):
            due = rows.iloc[at].reset_index(drop=True)
            starts = np.flatnonzero(np.diff(place[at], prepend=-1)).tolist()
            names = due[self._keys].iloc[starts].astype(object)
            names = names.where(names.notna(), None).itertuples(index=False, name=None)
            made: dict[str, list] = {}
            for name, start, end in zip(names, starts, [*starts[1:], len(due)]):
                state, events = self._fold.step(held.get(name), due.iloc[start:end])
                held[name] = tuple(state)
                for column, values in events.items():
                    made.setdefault(column, []).append(values)
            joined = {c: parts[0] if len(parts) == 1 else list(chain.from_iterable(parts)) for c, parts in made.items()}
            out = due[["_order"]].assign(**joined)
            out["_ts"] = pd.to_datetime(due["_us"], unit="us", utc=True)
            yield out.assign(**{k: due[k] for k in self._keys})

    def _patience(self, state: tuple, passed: int) -> int:
        """Microseconds until the state is spent, found by doubling; 0 if it is."""
        if self._fold.spent(state, passed):
            return 0
        wait = 1_000_000
        while wait < _NEVER and not self._fold.spent(state, passed + wait):
            wait *= 2
        return wait

    def _booked(self) -> tuple[int, int | None]:
        return self._book.get() if self._book.exists() else (0, None)

    def _wake_after(self, us: int | None, parts: int, timer: int | None = None) -> None:
        """Note ``parts``, and have a timer for ``us``, if any, where ``timer`` isn't one that is earlier."""
        ms = None if us is None else us // 1000 + 1
        if ms is not None and (timer is None or ms < timer):
            if timer is not None:
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(ms)
            timer = ms
        if timer is None:
            self._book.clear()
        else:
            self._book.update((parts, timer))

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame) -> bytes:
    """Rows as one value of a state: an Arrow stream of one batch."""
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False).replace_schema_metadata()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(value: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(value) as stream:
        return stream.read_pandas()


def _pieces(rows: np.ndarray) -> Iterator[np.ndarray]:
    return (rows[start : start + FRAME_ROWS] for start in range(0, len(rows), FRAME_ROWS))


def _order_of(place: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    """Positions of the rows by place, time and order; equal ones as they came."""
    if rows["_order"].dtype.kind in "iuf":
        return np.lexsort((rows["_order"].to_numpy(), rows["_us"].to_numpy(), place))
    keyed = rows[["_us", "_order"]].assign(_place=place).reset_index(drop=True)
    return keyed.sort_values(["_place", "_us", "_order"]).index.to_numpy()


def _plain(value):
    """A state's value as Python has it, not numpy."""
    return value.tolist() if hasattr(value, "tolist") else value


def _as_text(name: str, kind: T.DataType) -> Column:
    """A key as text that tells all keys apart; Python gets no nulls among numbers."""
    if isinstance(kind, T.BinaryType):
        return F.hex(name)
    if isinstance(kind, T.TimestampType):  # local time may be ambiguous
        return F.unix_micros(name).cast("string")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise TypeError(f"{name} is no plain key: {kind.simpleString()}")
    return F.col(name).cast("string")


def _from_text(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.unhex(text)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(text.cast("long"))
    return text.cast(kind)


def in_order(
    rows: DataFrame, key: list[str], ts: str, order: str, extra: list[Column], fold: Fold, watermark: str | None
) -> DataFrame:
    """``(*key, ts, order, *events)``, one row for each that was not late, once the watermark passed it.

    Without ``watermark`` the column ``ts`` carries that of an earlier step. Rows without ``ts`` have
    no place in the order and are dropped.
    """
    timed = rows.where(F.col(ts).isNotNull())
    if watermark is not None:
        timed = timed.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    inside = ["_us", "_order", *timed.select(*extra).columns]
    columns = [micros(ts), F.col(order), *extra]
    kinds = {name: timed.schema[name].dataType for name in key}
    names = [f"key{k}" for k in range(len(key))]
    narrow = timed.select(
        F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).alias("bucket"),
        *[_as_text(name, kind).alias(n) for n, (name, kind) in zip(names, kinds.items())],
        F.col(ts).alias("in_ts"), *[c.alias(f"in{k}") for k, c in enumerate(columns)],
    )
    texts = [T.StructField(n, T.StringType()) for n in names]
    held = T.StructType([*texts, *T.StructType.fromDDL(fold.state).fields])
    events = T.StructType.fromDDL(fold.events)
    made = T.StructType([
        T.StructField("_order", narrow.schema["in1"].dataType), *events.fields, T.StructField("_ts", T.TimestampType()), *texts,
    ])
    out = narrow.groupBy("bucket").transformWithStateInPandas(
        _InOrder(fold, names, inside, held), made, outputMode="Append", timeMode="EventTime"
    )
    back = [_from_text(F.col(n), kind).alias(name) for n, (name, kind) in zip(names, kinds.items())]
    return out.select(*back, F.col("_ts").alias(ts), F.col("_order").alias(order), *events.names)


def _events(name: str, step: Callable) -> Callable:
    """A fold of one event column as one that names it."""

    def named(state, rows: pd.DataFrame):
        values, events = step(state, rows)
        return values, {name: events}

    return named


def ordered_rate_limit(
    requests: DataFrame, client: str, ts: str, order: str, limit: int = Params.rate_limit,
    window_seconds: float = Params.rate_window_seconds, watermark: str = "10 minutes",
) -> DataFrame:
    """``(client, ts, order, accepted)`` as ``rate_limit``; state goes when its window has passed."""
    width = round(window_seconds * 1_000_000)

    def step(state, rows):
        return _limit(limit, width, state, rows)

    def spent(state, us):
        return not len(state[0]) or state[0][-1] + width < us

    return in_order(requests, [client], ts, order, [], Fold("recent array<long>", "accepted boolean", _events("accepted", step), spent), watermark)


def ordered_ttl_cache(
    accesses: DataFrame, key: str, ts: str, order: str, ttl_seconds: float, watermark: str = "10 minutes",
    forget_seconds: float | None = None,
) -> DataFrame:
    """``(key, ts, order, event)`` as ``ttl_replay``.

    An entry that has outlived its time makes the next access ``expired`` instead of ``miss``, so
    it is kept, unless ``forget_seconds`` says how long that is to be remembered.
    """
    width = round(ttl_seconds * 1_000_000)

    def step(state, rows):
        return _ttl(width, state, rows)

    def spent(state, us):
        return forget_seconds is not None and state[0] + round(forget_seconds * 1_000_000) < us

    return in_order(accesses, [key], ts, order, [], Fold("set_us long", "event string", _events("event", step), spent), watermark)


def ordered_outage_events(
    probes: DataFrame, host: str, ts: str, order: str, ok: Column, threshold: int = 3, cooldown_minutes: int = 240,
    quiet_minutes: tuple[int, int] | None = None, send_recovery: bool = True, watermark: str = "10 minutes",
) -> DataFrame:
    """``(host, ts, order, streak, event)`` as ``outage_events``; a host that is up needs no state."""

    def step(state, rows):
        return _watched(threshold, cooldown_minutes * 60, quiet_minutes, send_recovery, state, rows)

    def spent(state, us):
        return state[0] == 0

    fold = Fold("fails long, alert_second long", "streak long, event string", step, spent)
    return in_order(probes, [host], ts, order, [ok.alias("_ok")], fold, watermark)


def _watched(threshold: int, cooldown: float, quiet_minutes: tuple[int, int] | None, send_recovery: bool, held, rows: pd.DataFrame):
    """The monitor's ``(fails, alert_second)`` after one host's rows, and their streaks and events.

    Only alerts are looked up one by one: all else is known from where the last good row lies.
    """
    fails, alerted = held or (0, None)
    good = rows["_ok"].eq(True).to_numpy(dtype=bool)  # an unknown probe failed
    second = rows["_us"].to_numpy() // 1_000_000
    at = np.arange(len(rows))
    since = np.maximum.accumulate(np.where(good, at, -1))
    streak = np.where(since < 0, at + 1 + fails, at - since)
    before = np.concatenate(([fails], streak[:-1]))
    quiet = np.zeros(len(rows), dtype=bool)
    if quiet_minutes is not None:
        minute, (low, high) = second // 60 % 1440, quiet_minutes
        quiet = (minute >= low) & (minute < high) if low < high else (minute >= low) | (minute < high)
    recovered = good & (before > 0) & bool(send_recovery)
    kinds = ["ok", "recovery", "recovery_quiet", "pending", "quiet", "cooldown", "alert"]
    code = np.select([recovered & quiet, recovered, good, streak < threshold, quiet], [2, 1, 0, 3, 4], 5)
    # What is left wants to alert; the rows of an outage lie next to each other among these.
    wanting = np.flatnonzero(code == 5)
    outage, seconds = since[wanting], second[wanting].tolist()
    starts = np.flatnonzero(np.diff(outage, prepend=-2)).tolist()
    alerts = []
    for start, end in zip(starts, [*starts[1:], len(seconds)]):
        if outage[start] < 0 and alerted is not None:
            start = bisect_left(seconds, alerted + cooldown, start, end)
        while start < end:
            alerts.append(start)
            start = bisect_left(seconds, seconds[start] + cooldown, start + 1, end)
    code[wanting[alerts]] = 6
    if alerts and outage[alerts[-1]] == since[-1]:
        alerted = seconds[alerts[-1]]
    elif since[-1] >= 0:
        alerted = None
    return (int(streak[-1]), alerted), {"streak": streak, "event": np.array(kinds, dtype=object)[code]}


def ordered_alert_states(
    evaluations: DataFrame, step_seconds: int, watermark: str | None = "10 minutes"
) -> DataFrame:
    """``(alertname, severity, series, eval_ts, for_seconds, state)`` as ``alert_states``.

    An inactive alert needs no state, and one without evaluations for longer than a step none either.
    """
    step_us = step_seconds * 1_000_000

    def step(state, rows):
        return _advance(step_us, state, rows.rename(columns={"_for": "for_seconds"}))

    def spent(state, us):
        return state[0] < 0 or state[1] + step_us < us

    fold = Fold("since_us long, last_us long", "state string", _events("state", step), spent)
    key = ["alertname", "severity", "series"]
    extra = [F.col("active").alias("_active"), F.col("for_seconds").alias("_for")]
    return in_order(evaluations, key, "eval_ts", "for_seconds", extra, fold, watermark)
