"""How the retrieval inputs are read from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Labels up to 5 form the internal collection, from 4 on the external one."""
    label = F.col("label")
    member = F.array_compact(
        F.array(
            F.when(label <= 5, F.lit("internal")),
            F.when(label >= 4, F.lit("external")),
        )
    )
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.explode(member).alias("collection"), "embedding"
    )


def vector_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector asks for its neighbours."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def payload(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("point_id"), "text")


def text_questions(spark: SparkSession, folder: str) -> DataFrame:
    """User turns; a turn is identified by conversation and turn number."""
    said = table(spark, folder, "conversations").where("role = 'user'")
    turn_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return said.select(turn_id.alias("query_id"), F.col("text").alias("q"))


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as requests with their duration in seconds, tokens and failure flag."""
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        (F.col("value") / 100).alias("seconds"),
        F.from_json("props", "k long")["k"].alias("tokens"),
        (F.col("event_type") == "error").alias("failed"),
    )


def naive(ts: Column | str) -> Column:
    """Timestamps without zone, the type of the input tables."""
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
