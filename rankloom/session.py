"""Session defaults and lineage cutting."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Applied by tests and the bench. On a cluster the same keys belong in
# spark-defaults; shuffle partitions there are sized for the data.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "8192",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(
    cores: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8
) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rankloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Not needed where it is installed on the cluster or passed with ``--py-files``.
    """
    sc = spark.sparkContext
    name = f"{__package__}.zip"
    if any(f.endswith("/" + name) for f in sc.listFiles):
        return
    folder = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="rankloom-code-")) / name
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(folder.rglob("*.py")):
            archive.write(source, source.relative_to(folder.parent))
    sc.addPyFile(str(target))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    A temporary folder is taken only under a local master, where driver and
    executors are one process.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="rankloom-ckpt-")
    sc.setCheckpointDir(shared)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and continue from the files.

    Used where a result is read several times and must not be computed again:
    range-partition boundaries, model calls, rounds of a loop.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_round(df: DataFrame) -> DataFrame:
    """Like ``settle``, for the tables that a loop carries from round to round.

    Spark keeps what it infers about a checkpoint's columns, and plans of later rounds infer
    more from that: planning takes twice as long each round. Of files nothing is inferred.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, column: str) -> DataFrame:
    """Like ``settle``, laid out so that a filter on ``column`` reads its rows only."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/by-{column}-{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)
