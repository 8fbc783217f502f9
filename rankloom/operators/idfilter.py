"""A filter of ids in eight megabytes: a scan is cut to what a join can use before it is shuffled.

An id's hash names one of ``SLOTS`` bits. The bits of the wanted ids are collected as the rows of
a small table, which is sent to the scan whatever the number of ids. A wanted id always
passes; others pass as often as bits are set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter; the table has at most SLOTS / 32,768 rows of 4 kB.
SLOTS = 1 << 26


def _slot(keys: list[str]) -> Column:
    # From 1 on: the bitmap functions count places of positive numbers in one way.
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)) + 1


def wanted_bits(ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``(_bucket, _bits)`` of the ids in ``keys``; at most eight megabytes in all."""
    slots = ids.select(_slot(keys).alias("_slot"))
    return slots.groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits")
    )


def passing(rows: DataFrame, keys: list[str], bits: DataFrame) -> DataFrame:
    """The ``rows`` whose bit is set: all with a wanted id, and few others while few bits are."""
    placed = rows.withColumn("_slot", _slot(keys)).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
    at = F.expr("CAST(bitmap_bit_position(_slot) AS INT)")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = placed.join(F.broadcast(bits), "_bucket")
    return met.where(F.getbit(byte, at % 8) == 1).select(rows.columns)
