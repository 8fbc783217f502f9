"""Documents that hold a benchmark item, by SimHash over windows of the item's size.

A window of a document and an item are alike if the weighted Jaccard similarity of their
word shingles, counted with repeats, is ``similarity`` or more. Both sides' SimHash bits
are signs of sums of +1 and -1 over the shingles. Likeness bounds how far such a sum can
move between an item and a window, so each item's bits with a larger sum than that are
the same in every window like it: the bits in doubt are the radius that has to be
searched. The 64 bits form eight blocks; an item is indexed in the block with the most
certain bits, under each value that its bits in doubt can take. A window looks up its
eight block values, so no window within an item's radius is missed. What is found and
agrees in the other certain bits is verified on the shingles themselves.

Windows are made where they can be alike. One that is alike shares most of its shingles
with the item; moved right to the first of these it is no less alike, unless the text
ends, so windows start at shared shingles or end with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import whole_text, written

#: Item shingles that may be sent to every executor: rows of a few dozen bytes each.
SENT_SHINGLES = 1_000_000
_DOC, _WINDOW = ["doc_id", "text_key"], ["doc_id", "text_key", "width", "size", "start"]


# Shingles are exploded by the outer forms: for the others Spark infers a filter on the array
# and pushes its whole expression below, where it finds the words anew for each shingle.


def _same(names: list[str]) -> list[Column]:
    """Equal in the tables ``a`` and ``b``, nulls too."""
    return [F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}")) for name in names]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _shingles(width: int) -> Column:
    """Hashes of the shingles of ``width`` words in the column ``words``."""
    words = ", ".join(f"words[i + {k}]" for k in range(width))
    return F.expr(
        f"IF(size(words) < {width}, CAST(array() AS array<bigint>),"
        f" transform(sequence(0, size(words) - {width}), i -> xxhash64({words})))"
    )


def _sums(counted: DataFrame, by: list[str]) -> DataFrame:
    """How often each of 64 bits is set in ``hash``, ``n`` times each: two counts of 32 bits in a number.

    A text has less than 2^31 bytes, and so shingles; no count runs into the other.
    """
    lanes = [
        F.expr(f"sum((shiftrightunsigned(hash, {k}) & 4294967297L) * n)").alias(f"lane{k}")
        for k in range(32)
    ]
    return counted.groupBy(*by).agg(*lanes)


def _bit_sum(bit: int) -> str:
    """The sum of +1 and -1 over ``size`` shingles, for one bit of the hash."""
    return f"(2 * (shiftrightunsigned(lane{bit % 32}, {32 * (bit // 32)}) & 4294967295L) - size)"


def _bits(condition: str) -> Column:
    """A 64-bit number of the bits whose sum fulfils a condition, ``{}`` in it."""
    parts = (f"IF({condition.format(_bit_sum(k))}, shiftleft(1L, {k}), 0L)" for k in range(64))
    return F.expr(" | ".join(parts))


def _block(value: str) -> Column:
    return F.expr(f"CAST(shiftrightunsigned({value}, 8 * block) & 255 AS int)")


def _items(items: DataFrame, width: int) -> DataFrame:
    """Items as ``(item_id, item_key, width, size, hash, n)``, a row for each shingle."""
    rows = items.select("item_id", whole_text().alias("text")).distinct()
    rows = rows.select("item_id", F.xxhash64("item_id", "text").alias("item_key"), _words(F.col("text")).alias("words"))
    parts = None
    for k in range(1, width + 1):
        own = rows.where(F.size("words") >= k if k == width else F.size("words") == k)
        own = own.select("item_id", "item_key", F.lit(k).alias("width"), _shingles(k).alias("all"))
        parts = own if parts is None else parts.unionAll(own)
    size, each = F.size("all").alias("size"), F.explode_outer("all").alias("hash")
    parts = parts.select("item_id", "item_key", "width", size, each)
    return parts.groupBy("item_id", "item_key", "width", "size", "hash").agg(F.count(F.lit(1)).alias("n"))


def _index(items: DataFrame, similarity: float) -> DataFrame:
    """``(item_key, width, item_size, print, certain, block, value)`` to look windows up in."""
    reach = 2 * (1 - similarity) / (1 + similarity)
    prints = _sums(items, ["item_key", "width", "size"])
    prints = prints.select(
        "item_key",
        "width",
        F.col("size").alias("item_size"),
        _bits("{} > 0").alias("print"),
        _bits(f"abs({{}}) > {reach!r}D * size + 1e-9D").alias("certain"),
    )
    prints = written(prints, "item-prints")  # long expressions, computed once
    blocks = prints.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("block"))
    blocks = blocks.withColumn("known", _block("certain"))
    best = blocks.groupBy("item_key").agg(F.max_by("block", F.struct(F.bit_count("known"), "block")).alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(255))).alias("value")
    values = blocks.join(best, ["item_key", "block"]).select("*", every)
    return values.where((_block("print").bitwiseXOR(F.col("value"))).bitwiseAND(F.col("known")) == 0).drop("known")


def _windows(hits: DataFrame, similarity: float) -> DataFrame:
    """Where windows of each item's size may be alike, from the positions of shared shingles."""
    # So many shingles must be shared: with o of them, o / (size + item_size - o) is the similarity.
    share = similarity / (1 + similarity)
    places = hits.groupBy(*_DOC, "item_key", "width", "item_size", "there").agg(
        F.sort_array(F.collect_set("at")).alias("at")
    )
    places = places.withColumn("size", F.least("item_size", "there"))
    places = places.withColumn("need", F.expr(f"CAST(ceil({share!r}D * (size + item_size) - 1e-9D) AS int)"))
    starts = F.expr(
        "array_distinct(transform(filter(sequence(0, size(at) - need),"
        " i -> at[i + need - 1] < at[i] + size), i -> least(at[i], there - size)))"
    )
    found = places.where("size(at) >= need").select(*_DOC, "width", "size", "there", F.explode(starts).alias("start"))
    return found.distinct()


def leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """Rows ``(doc_id, item_id, start, words, similarity)``, one for each leak, and ``text_key``.

    A leak is a document and an item of which the document holds a window alike. Of the
    windows that start at a shared shingle or end with the text, among which is one of the
    most alike ones, the most alike counts, then the first. ``start`` is its first word (from 0) and
    ``words`` its length in words. Words are runs of letters and digits in lower case;
    shingles have ``width`` words, for shorter items all their words. A window has as
    many shingles as the item, or all of a shorter text. Null and empty texts and items
    without words leak nothing. Rows that repeat count once, texts that share a
    ``doc_id`` apart (``text_key`` tells them apart), and other columns are not read.
    """
    own_items = written(_items(items, width), "items")
    renamed = F.col("size").alias("item_size"), F.col("n").alias("item_n")
    shingles = own_items.select("item_key", "width", "hash", *renamed)
    widths = [r[0] for r in own_items.select("width").distinct().collect()]
    send = F.broadcast if own_items.count() <= SENT_SHINGLES else (lambda table: table)
    index = written(_index(own_items, similarity), "item-index")

    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    with_words = rows.select(*_DOC, _words(F.col("text")).alias("words"))
    hits = None
    for k in widths:
        at = with_words.select(*_DOC, _shingles(k).alias("all"))
        at = at.select(*_DOC, F.size("all").alias("there"), F.posexplode_outer("all").alias("at", "hash"))
        found = at.join(send(shingles.where(F.col("width") == k)), "hash").drop("hash", "item_n")
        hits = found if hits is None else hits.unionAll(found)
    if hits is None:  # no item has a word
        kind = items.schema["item_id"].dataType
        return rows.where("false").select(
            "doc_id", F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("start"),
            F.lit(0).alias("words"), F.lit(0.0).alias("similarity"), "text_key",
        )
    windows = written(_windows(hits, similarity), "windows")

    wanted = windows.select(*_DOC).distinct()
    texts = rows.alias("a").join(wanted.alias("b"), _same(_DOC), "left_semi").dropDuplicates(_DOC)
    texts = texts.select("doc_id", "text_key", _words(F.col("text")).alias("words"))
    spans = None
    for k in widths:
        at = texts.select(*_DOC, _shingles(k).alias("all"))
        own = windows.where(F.col("width") == k)
        part = at.alias("a").join(own.alias("b"), _same(_DOC)).select(
            "b.*", F.explode_outer(F.slice("all", F.col("start") + 1, F.col("size"))).alias("hash")
        )
        spans = part if spans is None else spans.unionAll(part)
    counted = spans.groupBy(*_WINDOW, "there", "hash").agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted, "window-shingles")

    prints = _sums(counted, [*_WINDOW, "there"]).select(*_WINDOW, "there", _bits("{} > 0").alias("own"))
    prints = written(prints, "window-prints")
    looked_up = prints.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("block"))
    looked_up = looked_up.withColumn("value", _block("own"))
    agree = (F.col("own").bitwiseXOR(F.col("print"))).bitwiseAND(F.col("certain")) == 0
    fits = F.col("size") == F.least("item_size", "there")
    candidates = looked_up.join(send(index), ["width", "block", "value"]).where(agree & fits)
    candidates = candidates.select(*_WINDOW, "item_key", "item_size")
    shared = candidates.alias("a").join(counted.alias("b"), _same(_WINDOW)).select("a.*", "hash", "n")
    shared = shared.join(send(shingles.select("item_key", "hash", "item_n")), ["item_key", "hash"])
    common = shared.groupBy(*_WINDOW, "item_key", "item_size").agg(F.sum(F.least("n", "item_n")).alias("common"))
    alike = common.withColumn("similarity", F.col("common") / (F.col("size") + F.col("item_size") - F.col("common")))
    alike = alike.where(F.col("similarity") >= similarity - 1e-12)
    back, words = (-F.col("start")).alias("back"), (F.col("size") + F.col("width") - 1).alias("words")
    best = alike.groupBy(*_DOC, "item_key").agg(F.max(F.struct("similarity", back, words)).alias("b"))
    names = own_items.select("item_key", "item_id").distinct()
    return best.join(send(names), "item_key").select(
        "doc_id", "item_id", (-F.col("b.back")).alias("start"), "b.words", "b.similarity", "text_key"
    )


def without_leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; see ``leaks``."""
    found = leaks(docs, items, similarity, width).select("doc_id", "text_key").distinct()
    found = written(found, "leaking")
    text_key = F.xxhash64(F.coalesce(F.col("a.text").cast("string"), F.lit("")))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (text_key == F.col("b.text_key"))
    return docs.alias("a").join(found.alias("b"), same, "left_anti")
