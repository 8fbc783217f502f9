"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import hashlib
import pickle
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rankloom.session import ensure_checkpoint_dir

#: The white space that the contracts name: space, and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]"


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder in ``spark.checkpoint.dir``, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and kept when executors are lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end and the offsets of its rows, nulls as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def arrow_schema(columns: str) -> pa.Schema:
    """The Arrow schema of columns in DDL; made on the driver, sent along with a function."""
    return to_arrow_schema(StructType.fromDDL(columns))


def with_id(ids: pa.Array, made: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of ``doc_id`` and the columns that rows of ``made`` have, typed by ``schema``."""
    columns = zip(*made) if made else ([] for _ in schema)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.record_batch([ids, *arrays], ["doc_id", *schema.names])


def content_key(value: object) -> str:
    """Tells what a Python worker has built from one broadcast value from what of another."""
    return hashlib.sha256(pickle.dumps(value)).hexdigest()
