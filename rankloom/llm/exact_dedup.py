"""Exact duplicates: texts equal but for white space, grouped by a 128-bit hash and their bytes.

The hash deals the rows out and the bytes decide: texts of one hash that differ are
different classes. Copies within a map task collapse before the shuffle, so a class with
a third of all rows arrives as one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import BLANKS, whole_text, written

_LAST_ID = 2**63 - 1
# A row's rank within its class in one number: longer first, then the smaller id.
_STEP = "CAST(18446744073709551616 AS DECIMAL(20,0))"


def _normal(docs: DataFrame) -> DataFrame:
    text = whole_text()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text).alias("length"),
        F.regexp_replace(text, f"{BLANKS}+", "").alias("normal"),
    )
    return rows.select(
        "*", F.md5("normal").alias("hash"), F.sha2("normal", 256).alias("text_sha256")
    )


def duplicate_classes(docs: DataFrame) -> DataFrame:
    """Rows ``(hash, text_sha256, keep_id, group_size)``, one for each distinct text.

    ``keep_id`` is the row with the most code points before white space is removed, then
    the smallest ``doc_id``; a null id comes last. Should two different texts agree in
    both hashes, the job fails instead of calling them equal.
    """
    rank = F.expr(
        f"CAST(CAST(length AS DECIMAL(10,0)) * {_STEP} AS DECIMAL(38,0))"
        f" + CAST({_LAST_ID} AS DECIMAL(20,0)) - CAST(coalesce(doc_id, {_LAST_ID}) AS DECIMAL(20,0))"
    ).cast("decimal(38,0)")
    rows = _normal(docs).withColumn("rank", rank)
    # The bytes are part of the key, so a group holds one text.
    texts = rows.groupBy("hash", "normal", "text_sha256").agg(
        F.max("rank").alias("rank"), F.count(F.lit(1)).alias("group_size")
    )
    by_hash = Window.partitionBy("hash", "text_sha256")
    alone = F.count(F.lit(1)).over(by_hash) == 1
    left = F.expr(f"CAST(rank % {_STEP} AS DECIMAL(20,0))")
    keep = (F.lit(_LAST_ID).cast("decimal(20,0)") - left).cast("long")
    return texts.select("hash", "text_sha256", "rank", "group_size").select(
        "hash",
        "text_sha256",
        F.when(keep != _LAST_ID, keep).alias("keep_id"),
        F.when(alone, F.col("group_size"))
        .otherwise(F.raise_error(F.lit("two texts agree in two hashes")).cast("long"))
        .alias("group_size"),
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, keep_id, group_size, kept, text_sha256)``, one for each row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Null and empty
    texts, and texts of white space only, are one class. Rows that repeat a ``doc_id``
    with the same text are the same document and get the same verdict. A null ``doc_id``
    is kept only where its class has no other.
    """
    rows = _normal(docs).select("doc_id", "hash", "text_sha256")
    # Written, so that the join meets two plain exchanges and Spark can split a large class.
    joined = rows.join(written(duplicate_classes(docs), "classes"), ["hash", "text_sha256"])
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat, one.

    Rows that go are fewer than those that stay, so their ids are what the texts meet.
    Rows without ``doc_id`` and ids of several rows are told apart by their text.
    """
    verdicts = written(exact_duplicates(docs).select("doc_id", "kept", "text_sha256"), "verdicts")
    by_id = verdicts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_and("kept").alias("kept"))
    several = (F.col("rows") > 1) | F.col("doc_id").isNull()
    odd = written(by_id.where(several).select("doc_id"), "odd-ids")
    gone = written(by_id.where(several | ~F.col("kept")).select("doc_id"), "gone")
    same_id = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    stay = docs.alias("a").join(gone.alias("b"), same_id, "left_anti")
    if odd.isEmpty():
        return stay
    row = F.struct(*[F.col(f"a.`{name}`") for name in docs.columns]).alias("row")
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col("a.text"), F.lit("")), f"{BLANKS}+", ""), 256)
    texts = docs.alias("a").join(odd.alias("b"), same_id, "left_semi").select(row, sha.alias("sha"))
    kept = verdicts.where("kept").select("doc_id", "text_sha256").distinct()
    same = F.col("row.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("sha") == F.col("k.text_sha256"))
    told = texts.join(kept.alias("k"), same).select("row", "k.doc_id", "k.text_sha256")
    return stay.unionAll(told.dropDuplicates(["doc_id", "text_sha256"]).select("row.*"))
