"""Mixing sources to target weights: water-filling under a cap of epochs, then seeded sampling.

All sources share a budget of words by their weights. A source whose share would repeat it
more often than ``epochs`` times is held at that cap, and what it can't use is shared out
again among the open ones, until no share is above its cap. Each round is one aggregation
over the table of sources and brings two sums to the driver.

A source's target is then so many whole repetitions of all its documents, and a fraction of
one more. The fraction goes to the documents that come first in a seeded order, as far as
their words fit; of the rest, the one document that brings the sum nearest is added. The
place in the order where the words are used up is found by digits of the order's key, so a
source with very many documents is counted in cells, and never sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import whole_text, written

#: Words are what stands between white space.
WORDS = r"[^\x20\x09-\x0D]+"

#: Hexadecimal digits of the key that tell the cells of one round apart: at most 4,096 cells a source.
DIGITS = 3


def _with_draw(rows: DataFrame, seed: int) -> DataFrame:
    """Add ``draw``, a key that puts a source's documents into a seeded order."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    key = F.concat_ws(":", F.lit(str(seed)), name, F.col("size").cast("string"))
    return rows.withColumn("draw", F.md5(key))


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    """Rows ``(doc_id, source, size, draw)``: a document's words and its key in the order."""
    size = F.regexp_count(whole_text(), F.lit(WORDS)).cast("long").alias("size")
    return _with_draw(docs.select("doc_id", F.col("source").cast("string").alias("source"), size), seed)


def repeating_weights(sources: DataFrame, cycle: list[int]) -> DataFrame:
    """Add ``weight``: the numbers of ``cycle`` in turn, sources by code point, null last.

    Places are counted in ranges of the order and the ranges' sizes added up, so that no
    task holds all sources.
    """
    null_last = [F.col("source").isNull(), F.col("source")]
    ranges = sources.repartitionByRange(*null_last).withColumn("range", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("range").orderBy(*null_last))
    placed = written(ranges.withColumn("place", place), "placed")
    upto = F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    before = placed.groupBy("range").count().select("range", F.coalesce(upto, F.lit(0)).alias("before"))
    turn = F.col("before") + F.col("place") - 1
    weight = F.element_at(F.array(*map(F.lit, cycle)), (turn % len(cycle) + 1).cast("int"))
    return placed.join(before, "range").select(*sources.columns, weight.alias("weight"))


def targets(sources: DataFrame, epochs: int, budget: int | None = None) -> DataFrame:
    """Add ``target`` to rows ``(source, source_size, weight)``: the words that each is to give.

    ``budget`` words are shared out, by default all there are. A source without a positive
    weight gives none; if the caps hold fewer words than the budget, all sources give their caps.
    """
    cap = F.col("source_size") * F.lit(epochs)
    weight = F.when(F.col("weight") > 0, F.col("weight").cast("decimal(20,6)"))
    weighed = sources.withColumn("cap", cap).withColumn("exact", weight)
    if budget is None:
        budget = int(weighed.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0] or 0)
    level = 0.0  # words for each unit of weight
    while True:
        full = F.col("cap") <= F.col("exact").cast("double") * F.lit(level)
        held, shared = weighed.where("exact IS NOT NULL").agg(
            F.sum(F.when(full, F.col("cap").cast("decimal(38,0)"))), F.sum(F.when(~full, F.col("exact")))
        ).first()
        if not shared:
            level = math.inf
            break
        risen = float(budget - int(held or 0)) / float(shared)
        if risen <= level:
            break
        level = risen
    target = F.least(F.col("cap").cast("double"), F.col("exact").cast("double") * F.lit(level))
    target = F.when(F.col("exact").isNotNull(), target).otherwise(0.0)
    return weighed.withColumn("target", target).drop("cap", "exact")


def _cut(cells: DataFrame, key: str) -> DataFrame:
    """Of each source the first cell, in the order of ``key``, at whose end the words exceed ``more``."""
    order = Window.partitionBy("source").orderBy(key)
    upto = F.col("before") + F.sum("words").over(order)
    cells = cells.withColumn("upto", upto).where("upto > more AND upto - words <= more")
    return cells.select("source", "more", key, (F.col("upto") - F.col("words")).alias("before"))


def _edges(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows ``(source, edge, rest)``: documents before ``edge`` are repeated once more, ``rest`` words are left."""
    cell = F.substring("draw", 1, DIGITS).alias("cell")
    cells = sized.groupBy("source", cell).agg(F.sum("size").alias("words"))
    more = plan.select(F.col("source").alias("of"), "more")
    same = F.col("source").eqNullSafe(F.col("of"))
    found = _cut(cells.join(more, same).drop("of").withColumn("before", F.lit(0).cast("long")), "cell")
    for digits in (2 * DIGITS, 32):
        found = written(found, "cells").select(
            F.col("source").alias("of"), "more", "before", F.col("cell").alias("within")
        )
        inside = F.substring("draw", 1, digits - DIGITS if digits == 2 * DIGITS else 2 * DIGITS)
        rows = sized.join(found, same & (inside == F.col("within")))
        cell = F.substring("draw", 1, digits).alias("cell")
        cells = rows.groupBy("source", "more", "before", cell).agg(F.sum("size").alias("words"))
        found = _cut(cells, "cell")
    return found.select("source", F.col("cell").alias("edge"), (F.col("more") - F.col("before")).alias("rest"))


def plan(sized: DataFrame, weights, epochs: int, budget: int | None = None) -> DataFrame:
    """One row for each source: ``(source, source_size, target, whole, edge, added)``.

    ``weights`` adds the column ``weight`` to rows ``(source, source_size)``. All documents
    are taken ``whole`` times; those with a ``draw`` before ``edge`` or equal to ``added``
    once more.
    """
    sources = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    shares = targets(written(weights(sources), "weights"), epochs, budget)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    shares = shares.withColumn("whole", F.least(whole, F.lit(epochs)).cast("long"))
    more = F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    shares = written(shares.withColumn("more", more).drop("weight"), "shares")
    edges = written(_edges(sized, shares), "edges")
    of = edges.withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    off = F.abs(F.col("rest") - F.col("size"))
    best = F.min(F.struct(off.alias("off"), "size", "draw")).alias("best")
    beyond = sized.join(of, same & (F.col("draw") >= F.col("edge")))
    added = beyond.where(off < F.col("rest")).groupBy(F.col("source").alias("for")).agg(best)
    full = shares.join(of, same, "left")
    full = full.join(added, F.col("source").eqNullSafe(F.col("for")), "left")
    full = full.select("source", "source_size", "target", "whole", "edge", F.col("best.draw").alias("added"))
    return written(full, "mixture")


def _times() -> Column:
    once_more = (F.col("draw") < F.col("edge")) | (F.col("draw") == F.col("added"))
    return F.col("whole") + F.coalesce(once_more, F.lit(False)).cast("long")


def mixture(docs: DataFrame, weights, epochs: int = 3, seed: int = 13, budget: int | None = None) -> DataFrame:
    """Rows ``(doc_id, source, size, source_size, target, times, taken)``, one for each row of ``docs``.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; other columns are not read. A null
    text has no words. A null source is a source of its own. The mix holds a document
    ``times`` times, at most ``epochs``, which are ``taken`` words; a source's sum differs
    from its target by half a document at most where no other document comes nearer. Rows
    that repeat a ``doc_id`` (or have none) and a size are taken alike. Which documents are
    taken depends on ids, sizes and ``seed`` alone, so reruns agree. An empty table gives none.
    """
    sized = written(sizes(docs, seed), "sizes")
    shares = plan(sized, weights, epochs, budget).withColumnRenamed("source", "of")
    rows = sized.join(shares, F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumn("times", _times())
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "times",
        (F.col("size") * F.col("times")).alias("taken"),
    )


def mixed(docs: DataFrame, weights, epochs: int = 3, seed: int = 13, budget: int | None = None) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as ``mixture`` says."""
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row")
    size = F.regexp_count(whole_text(), F.lit(WORDS)).cast("long").alias("size")
    full = docs.select(row, "doc_id", F.col("source").cast("string").alias("source"), size)
    shares = plan(written(sizes(docs, seed), "sizes"), weights, epochs, budget).withColumnRenamed("source", "of")
    rows = _with_draw(full, seed).join(shares, F.col("source").eqNullSafe(F.col("of")))
    copies = rows.withColumn("times", _times()).where("times > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")
