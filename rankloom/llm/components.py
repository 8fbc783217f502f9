"""Connected components of a table of links, by stars that grow and shrink in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import written

#: Keys of rows that go, 16 bytes each, that may be sent to every executor.
SENT_KEYS = 1_000_000


def _pull(links: DataFrame, over: str, whole: bool) -> DataFrame:
    """Tie what a node is linked with to the least node it is linked with.

    The minima are written first: a join of two plain exchanges is one that Spark
    splits where a node has very many links.
    """
    least = written(links.groupBy(over).agg(F.min("other").alias("least")), "least")
    moved = links.join(least, over)
    if whole:  # both ends of each link move
        return moved.select(F.explode(F.array(over, "other")).alias("node"), "least")
    return moved.where(F.col("other") > F.col(over)).select(
        F.col("other").alias("node"), F.least(F.col(over), "least").alias("least")
    )


def _tidy(links: DataFrame) -> DataFrame:
    return links.where("node > least").select("node", F.col("least").alias("other")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows ``(node, component)`` of the nodes in ``links (a, b)``, without the least nodes.

    ``component`` is the least node reachable. Links to oneself, repeated links, both
    directions of one link and links with a null end change nothing; no links give no
    rows. Each round is a few equi-joins over the links that are left, one star for each
    component in the end; the number of rounds grows with the logarithm of a
    component's width.
    """
    a, b = F.col("a"), F.col("b")
    stars = written(_tidy(links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("least"))
                          .where(a.isNotNull() & b.isNotNull())), "links")
    before = None
    while True:
        seen = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "other").cast("decimal(20,0)")))
        now = tuple(seen.first())
        if now == before or not now[0]:
            return stars.select("node", F.col("other").alias("component"))
        before = now
        both = stars.unionAll(stars.select(F.col("other").alias("node"), F.col("node").alias("other")))
        grown = written(_tidy(_pull(both, "node", whole=False)), "grown")
        stars = written(_tidy(_pull(grown, "node", whole=True)), "stars")


def least_of_each(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are first in their component, with all their columns.

    ``labels`` are ``(doc_id, text_key, component)``, ``text_key`` being the text's ``xxhash64``.
    First is the smallest ``doc_id``, null last, then the smallest ``text_key``. Rows that go are
    fewer than those that stay, so their keys are what the texts meet.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("nobody"), "doc_id", "text_key")
    labels = written(labels.select("component", rank.alias("rank")), "labels")
    several = labels.groupBy("component").agg(F.min("rank").alias("least"), F.max("rank").alias("most"))
    several = written(several.where("least != most").select("component", "least"), "several")
    gone = labels.join(several, "component").where("rank != least").select("rank.doc_id", "rank.text_key").distinct()
    gone = written(gone, "gone")
    if gone.count() <= SENT_KEYS:
        gone = F.broadcast(gone)
    text_key = F.xxhash64(F.coalesce(F.col("a.text").cast("string"), F.lit("")))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (text_key == F.col("b.text_key"))
    return docs.alias("a").join(gone.alias("b"), same, "left_anti")
