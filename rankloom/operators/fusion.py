"""Reciprocal-rank fusion of the ranked lists of two collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.similarity import EXTERNAL, INTERNAL
from rankloom.params import Params


def reciprocal_rank_fusion(hits: DataFrame, k: int = Params.rrf_k) -> DataFrame:
    """``(query_id, point_id, fused_score, source, internal_rank, external_rank, fused_rank)``.

    ``hits`` carries ``query_id, collection, point_id, rank``. Ids are compared as
    text. Equal scores keep list order: better internal rank first, ids without an
    internal rank after them in external order. When ``hits`` is already
    partitioned by ``query_id``, as ``search`` leaves it, nothing here shuffles.
    """
    inside, outside = F.col("collection") == INTERNAL, F.col("collection") == EXTERNAL
    gain = F.lit(1.0) / (F.lit(k) + F.col("rank"))
    merged = hits.groupBy("query_id", F.col("point_id").cast("string").alias("point_id")).agg(
        F.sum(F.when(inside, gain)).alias("_inside"),
        F.sum(F.when(outside, gain)).alias("_outside"),
        F.min(F.when(inside, F.col("rank"))).alias("internal_rank"),
        F.min(F.when(outside, F.col("rank"))).alias("external_rank"),
    )
    zero = F.lit(0.0)
    scored = merged.select(
        "query_id",
        "point_id",
        (F.coalesce("_inside", zero) + F.coalesce("_outside", zero)).alias("fused_score"),
        provenance(F.col("internal_rank"), F.col("external_rank")).alias("source"),
        "internal_rank",
        "external_rank",
    )
    return scored.withColumn("fused_rank", F.row_number().over(fused_order()))


def fused_order():
    return Window.partitionBy("query_id").orderBy(
        F.desc("fused_score"),
        F.asc_nulls_last("internal_rank"),
        F.asc_nulls_last("external_rank"),
        F.asc("point_id"),
    )


def provenance(internal_rank: Column, external_rank: Column) -> Column:
    return (
        F.when(internal_rank.isNotNull() & external_rank.isNotNull(), F.lit("both"))
        .when(internal_rank.isNotNull(), F.lit(INTERNAL))
        .otherwise(F.lit(EXTERNAL))
    )


def hit_counts(hits: DataFrame) -> DataFrame:
    """List lengths per question (not distinct ids) and the size of the merged list."""
    return hits.groupBy("query_id").agg(
        F.count_if(F.col("collection") == INTERNAL).alias("internal_hits"),
        F.count_if(F.col("collection") == EXTERNAL).alias("external_hits"),
        F.size(F.collect_set(F.col("point_id").cast("string"))).cast("long").alias("fused_results"),
    )


def overlap(fused: DataFrame) -> DataFrame:
    """Hits both collections returned."""
    return fused.where(F.col("source") == "both")


def exclusive(fused: DataFrame, collection: str) -> DataFrame:
    """Hits only ``collection`` returned."""
    return fused.where(F.col("source") == collection)


def retrieval_outcome(counts: DataFrame) -> DataFrame:
    """Questions answered from the corpus (hit) against those without any hit (miss)."""
    return counts.groupBy(
        F.when(F.col("fused_results") > 0, F.lit("hit")).otherwise(F.lit("miss")).alias("outcome")
    ).agg(F.count("*").alias("questions"))
