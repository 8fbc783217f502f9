"""Replay of a TTL + LRU answer cache over a log of key accesses.

A hit does not extend an entry's life, expiry is noticed on access only, and every
access makes its key the most recent one. The replayed cache is one global cache
and each access stores its answer before the next access.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.admission import admit
from rankloom.operators.clock import micros
from rankloom.session import settle


def ttl_replay(
    accesses: DataFrame, key: str, ts: str, order: str, ttl_seconds: float, **options
) -> DataFrame:
    """``(key, ts, order, event)`` with event miss, hit or expired, without eviction.

    Storing happens at the first access and then at each first access older than
    the TTL: greedy admission of one event per window.
    """
    return _label_events(admit(accesses, [key], ts, order, 1, ttl_seconds, **options), [key], ts, order)


def _label_events(decided: DataFrame, chain: list[str], ts: str, order: str) -> DataFrame:
    # Only stored accesses need the "first of its chain" test. They are at least a
    # TTL apart, which bounds the group of even the hottest key.
    along = Window.partitionBy(*chain).orderBy(ts, order)
    stored = decided.where("admitted").withColumn(
        "event",
        F.when(F.row_number().over(along) == 1, F.lit("miss")).otherwise(F.lit("expired")),
    )
    served = decided.where(~F.col("admitted")).withColumn("event", F.lit("hit"))
    return stored.unionByName(served).drop("admitted")


def lru_replay(
    accesses: DataFrame,
    key: str,
    ts: str,
    order: str,
    max_entries: int,
    ttl_seconds: float | None = None,
    chunks: int | None = None,
    **options,
) -> DataFrame:
    """``(key, ts, order, event, evicted)`` under at most ``max_entries`` keys.

    The log is range-partitioned by time into ``chunks``. The cache content at
    the start of a chunk is the ``max_entries`` most recently used keys before
    it, and "most recent keys" merge associatively: a doubling prefix over the
    chunks computes all start contents in log2(chunks) rounds of at most
    ``2 x max_entries`` rows per chunk. Then all chunks replay in parallel.
    """
    spark = accesses.sparkSession
    chunks = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The chunk borders come from sampling; they are written once and never redrawn.
    log = settle(
        accesses.select(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(order).alias("o"))
        .withColumn("us", micros("t"))
        .repartitionByRange(chunks, "us", "o")
        .withColumn("chunk", F.spark_partition_id())
    )
    start = _start_contents(log, max_entries, chunks)
    replayed = _replay_chunks(log, start, max_entries)
    if ttl_seconds is None:
        out = replayed.withColumn(
            "event", F.when(F.col("present"), F.lit("hit")).otherwise(F.lit("miss"))
        )
    else:
        stays = settle(_number_stays(settle(replayed)))
        chain = ["k", "stay_us", "stay_o"]
        decided = admit(stays, chain, "t", "o", 1, ttl_seconds, carry=["evicted"], **options)
        out = _label_events(decided, chain, "t", "o")
    return out.select(
        F.col("k").alias(key), F.col("t").alias(ts), F.col("o").alias(order), "event", "evicted"
    )


def _most_recent(keys: DataFrame, max_entries: int) -> DataFrame:
    latest = keys.groupBy("chunk", "k").agg(F.max("seen").alias("seen"))
    place = F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("seen")))
    return latest.withColumn("place", place).where(F.col("place") <= max_entries).drop("place")


def _start_contents(log: DataFrame, max_entries: int, chunks: int) -> DataFrame:
    """``(chunk, k, seen)``: the keys a chunk finds in the cache."""
    state = settle(
        _most_recent(
            log.select((F.col("chunk") + 1).alias("chunk"), "k", F.struct("us", "o").alias("seen")),
            max_entries,
        )
    )
    reach = 1
    while reach < chunks:
        shifted = state.withColumn("chunk", F.col("chunk") + reach).where(F.col("chunk") < chunks)
        state = settle(_most_recent(state.unionByName(shifted), max_entries))
        reach *= 2
    return state


def _replay_chunks(log: DataFrame, start: DataFrame, max_entries: int) -> DataFrame:
    found = start.select(
        "chunk",
        "k",
        F.col("seen.us").alias("us"),
        F.col("seen.o").alias("o"),
        F.lit(None).cast(log.schema["t"].dataType).alias("t"),
        F.lit(True).alias("seed"),
    )
    schema = T.StructType(
        [
            *log.select("chunk", "k", "us", "o", "t").schema.fields,
            T.StructField("present", T.BooleanType()),
            T.StructField("evicted", T.BooleanType()),
        ]
    )
    rows = log.withColumn("seed", F.lit(False)).unionByName(found)
    return (
        rows.repartition("chunk")
        .sortWithinPartitions("chunk", "us", "o")
        .mapInArrow(partial(_replay, max_entries), schema)
    )


def _replay(max_entries: int, batches: Iterable[pa.RecordBatch]):
    chunk, cache = None, OrderedDict()
    for batch in batches:
        present, evicted = [], []
        columns = (batch.column(c).to_pylist() for c in ("chunk", "k", "seed"))
        for at, key, seed in zip(*columns):
            if at != chunk:
                chunk, cache = at, OrderedDict()
            known = key in cache
            cache[key] = None
            cache.move_to_end(key)
            full = len(cache) > max_entries
            if full:
                cache.popitem(last=False)
            if not seed:
                present.append(known)
                evicted.append(full)
        own = batch.filter(pa.compute.invert(batch.column("seed"))).select(
            ["chunk", "k", "us", "o", "t"]
        )
        yield own.append_column("present", pa.array(present, pa.bool_())).append_column(
            "evicted", pa.array(evicted, pa.bool_())
        )


def _number_stays(replayed: DataFrame) -> DataFrame:
    """Name each stay of a key in the cache after the miss that began it.

    Inside a chunk the last miss of the key names the stay; otherwise the last
    miss in an earlier chunk does, looked up among one row per key and chunk.
    """
    placed = replayed.withColumn("_at", F.struct("k", "chunk"))
    inside = Window.partitionBy("_at").orderBy("us", "o").rowsBetween(Window.unboundedPreceding, 0)
    miss = F.when(~F.col("present"), F.struct("us", "o"))
    rows = placed.withColumn("stay", F.last(miss, ignorenulls=True).over(inside))
    per_chunk = placed.groupBy("_at").agg(F.max(miss).alias("latest"))
    earlier = (
        Window.partitionBy(F.col("_at.k"))
        .orderBy("_at.chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = per_chunk.select(
        "_at", F.last("latest", ignorenulls=True).over(earlier).alias("carried")
    )
    stay = F.coalesce("stay", "carried")
    return rows.join(carried, "_at").select(
        "k", "t", "o", "evicted", stay["us"].alias("stay_us"), stay["o"].alias("stay_o")
    )


def cache_stats(
    events: DataFrame, ttl_seconds: float, max_entries: int, enabled: bool = True
) -> DataFrame:
    """One row: enabled, size, ttl_seconds, max_entries and the four counters.

    ``events``: ``event`` and, for a bounded cache, ``evicted``. Entries enter on
    a miss and leave on an eviction; an expired access replaces its entry.
    """
    gone = F.col("evicted") if "evicted" in events.columns else F.lit(False)
    counts = events.agg(
        *[F.count_if(F.col("event") == name).alias(name) for name in ("hit", "miss", "expired")],
        F.count_if(gone).alias("evicted"),
    )
    return counts.select(
        F.lit(enabled).alias("enabled"),
        (F.col("miss") - F.col("evicted")).alias("size"),
        F.lit(ttl_seconds).alias("ttl_seconds"),
        F.lit(max_entries).alias("max_entries"),
        "hit",
        "miss",
        "expired",
        "evicted",
    )
