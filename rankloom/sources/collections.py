"""Point collections as tables: create, read, describe, audit, snapshot.

A collection lives in ``<root>/collection=<name>``. The dimension and metric sit
in the metadata of the ``embedding`` field and travel with the files.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.vectors import get_embedding_dimension, metric_name
from rankloom.operators.similarity import COLLECTIONS


def point_schema(dimension: int, metric: str, id_type: T.DataType | None = None) -> T.StructType:
    about = {"dim": dimension, "metric": metric_name(metric)}
    return T.StructType(
        [
            T.StructField("point_id", id_type or T.StringType()),
            T.StructField("embedding", T.ArrayType(T.FloatType()), metadata=about),
            T.StructField("text", T.StringType()),
            T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        ]
    )


def reset_collections(
    spark: SparkSession,
    root: str,
    names: str | Iterable[str] = COLLECTIONS,
    dimension: int = 0,
    metric: str = "cosine",
    provider: str = "openai",
    model: str = "text-embedding-3-small",
) -> None:
    """Drop and recreate collections empty; ``dimension`` 0 follows the model."""
    if isinstance(names, str):
        names = [n.strip() for n in names.split(",") if n.strip()]
    schema = point_schema(dimension or get_embedding_dimension(provider, model), metric)
    for name in names:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(_path(root, name))


def append_points(points: DataFrame, root: str, name: str) -> None:
    """Add points; the collection's stored dimension and metric are kept."""
    spark = points.sparkSession
    schema = read_collection(spark, root, name).schema
    about = schema["embedding"].metadata
    columns = []
    for field in schema:
        if field.name == "collection":
            continue
        value = F.col(field.name) if field.name in points.columns else F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name, metadata=field.metadata))
    dim = about["dim"]
    fits = F.assert_true(
        F.col("embedding").isNull() | (F.size("embedding") == dim),
        f"collection {name} holds vectors of dimension {dim}",
    ).isNull()
    points.select(*columns).where(fits).write.mode("append").parquet(_path(root, name))


def read_collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.option("basePath", root).parquet(_path(root, name))


def read_points(spark: SparkSession, root: str, names: Iterable[str] = COLLECTIONS) -> DataFrame:
    """Points of several collections with their ``collection`` column."""
    return reduce(
        lambda a, b: a.unionByName(b), [read_collection(spark, root, n) for n in names]
    )


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/collection={name}"


def list_collections(spark: SparkSession, root: str) -> list[str]:
    """Names of the stored collections, from the directory listing."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()]
    return sorted(n.removeprefix("collection=") for n in names if n.startswith("collection="))


def collection_exists(spark: SparkSession, root: str, name: str) -> bool:
    return name in list_collections(spark, root)


def get_collection_info(spark: SparkSession, root: str, name: str) -> DataFrame:
    if not collection_exists(spark, root, name):
        raise ValueError(f"Collection '{name}' not found or unreachable")
    points = read_collection(spark, root, name)
    return points.agg(
        F.lit(name).alias("name"),
        F.count("*").alias("points_count"),
        F.count("embedding").alias("vectors_count"),
    )


def collection_stats(points: DataFrame) -> DataFrame:
    """Points and vectors per collection of a points table."""
    return points.groupBy("collection").agg(
        F.count("*").alias("points_count"), F.count("embedding").alias("vectors_count")
    )


def dimension_audit(
    points: DataFrame, expected: int, required: Iterable[str] = COLLECTIONS
) -> DataFrame:
    """One row per required collection; ``ok`` is false for a missing or misfit one."""
    wanted = points.sparkSession.createDataFrame([(n,) for n in required], "collection string")
    found = points.groupBy("collection").agg(
        F.min(F.size("embedding")).alias("min_dim"),
        F.max(F.size("embedding")).alias("max_dim"),
        F.count("*").alias("points_count"),
    )
    fits = (F.col("min_dim") == expected) & (F.col("max_dim") == expected)
    return wanted.join(found, "collection", "left").select(
        "collection",
        F.lit(expected).alias("expected_dim"),
        "min_dim",
        "max_dim",
        F.coalesce("points_count", F.lit(0)).alias("points_count"),
        F.coalesce(fits, F.lit(False)).alias("ok"),
    )


def tuning_hint(points_count: Column) -> Column:
    """Suggested search breadth: twice the root of the size, within 64 and 512."""
    size = F.greatest(F.lit(1), F.coalesce(points_count, F.lit(0)))
    return F.least(F.lit(512.0), F.greatest(F.lit(64.0), F.lit(2.0) * F.sqrt(size))).cast("int")


def write_snapshot(df: DataFrame, path: str, taken_at: str) -> None:
    """Copy a table to ``<path>/snapshot_ts=<yyyyMMdd-HHmm>``."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/snapshot_ts={taken_at}")


def retention(snapshots: DataFrame, taken_at: Column, now: Column, keep_days: int = 14) -> DataFrame:
    """Add ``age_days`` (whole days) and ``keep``; a snapshot goes when older than ``keep_days``."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(taken_at.cast("timestamp"))
    aged = snapshots.withColumn("age_days", F.floor(seconds / F.lit(86400)).cast("long"))
    return aged.withColumn("keep", F.col("age_days") <= keep_days)
