"""Spelling variants: words one edit apart, found through pivotal grams, and the form each leads to.

A word's bigrams are put into one order for all words, rare ones first. The first few
are its gram prefix, with all others that equal the last of them. Two disjoint bigrams of
the prefix are its pivots. One edit spoils at most one of two disjoint bigrams, so of two
words one edit apart, the one whose prefix ends earlier in the order has a pivot that the
other has too, and there it lies in the prefix.

Position limits: the pivots cut a word into three segments, up to the end of the first, between
them, and from the second on. One edit lies in one segment, so whatever is before and behind
that segment stands in the other word unchanged, at the same place from the start and from the
end, with the pivot that is left. That is what pivots are looked up by; the other words
are indexed by what can stand so around the grams of their prefix. Of the prefix those two pivots
are chosen, by dynamic programming, whose segments leave the least to chance.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import whole_text, written

#: Runs of at least five letters; shorter ones can't become words.
RUNS = "[a-z\\u00C0-\\u00FF]{5,}"
#: A run of a document loses a letter if this divides its checksum.
SLIPS = 97
LETTERS = 5
OCCURRENCES = 3

#: Counters of the order of bigrams, told by checksum: a table of 512 kB for any alphabet.
COUNTERS = 1 << 16
EDITS = 1
GRAM = 2
#: Grams of a prefix; three would do, with more there are better pivots among them.
PREFIX = 5
#: Places of a prefix up to which pairs of them are indexed; a word of many equal grams has more.
PAIRED = 12
#: So many letters might stand where one does.
CHANCES = 6
_MASK, _ODD = (1 << 64) - 1, 0x9E3779B97F4A7C15


def spelled_words(docs: DataFrame) -> DataFrame:
    """Rows ``(word, n)``: words of the texts with seeded slips, and how often they occur.

    A document's run of letters is in lower case (A-Z only). Where the checksum of
    ``doc_id:run`` is a multiple of ``SLIPS``, the letter at the checksum modulo the
    length goes. Words have ``LETTERS`` letters and ``OCCURRENCES`` at least. A null text
    has no runs, a null ``doc_id`` counts as empty; other columns are not read.
    """
    lower = F.translate(whole_text(), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(RUNS), F.lit(0))).alias("run"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = runs.select("run", F.crc32(F.concat(name, F.lit(":"), "run").cast("binary")).alias("sum"))
    at = "CAST(sum % char_length(run) AS INT)"
    slip = F.expr(f"concat(substring(run, 1, {at}), substring(run, {at} + 2))")
    word = F.when(F.col("sum") % SLIPS == 0, slip).otherwise(F.col("run")).alias("word")
    counts = runs.select(word).where(F.char_length("word") >= LETTERS).groupBy("word")
    return counts.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OCCURRENCES)


def gram_counts(words: DataFrame) -> np.ndarray:
    """How many bigrams of ``words`` have each checksum modulo ``COUNTERS``."""
    gram = F.expr(f"explode(transform(sequence(1, char_length(word) - 1), i -> substring(word, i, {GRAM})))")
    grams = words.where(F.char_length("word") >= GRAM).select(gram.alias("gram"))
    slot = (F.crc32(F.col("gram").cast("binary")) % COUNTERS).cast("int").alias("slot")
    counts = np.zeros(COUNTERS, np.int64)
    for slot, count in grams.groupBy(slot).count().collect():  # at most COUNTERS rows
        counts[slot] = count
    return counts


def prefix_of(grams: list[tuple[int, str]]) -> list[int]:
    """Places of a word's gram prefix, from left to right; ``grams`` are ``(count, gram)`` by place."""
    last = sorted(grams)[min(PREFIX, len(grams)) - 1]
    return [at for at, gram in enumerate(grams) if gram <= last]


def pivots_of(prefix: list[int], length: int) -> tuple[int, ...]:
    """The places of ``EDITS + 1`` disjoint grams of a prefix that cut a word best.

    A segment of so many letters costs ``CHANCES`` to that power. ``cheapest[j]`` is the best
    way to take so many grams of which the last is the ``j``-th: from the first on, each is
    put behind the best of those that end before it.
    """
    costs = [CHANCES ** min(size, 64) for size in range(length + 1)]
    cheapest: list = [(costs[at + GRAM], (at,)) for at in prefix]
    for _ in range(EDITS):
        longer: list = []
        for j, at in enumerate(prefix):
            before = (c for c in cheapest[:j] if c and c[1][-1] + GRAM <= at)
            ways = ((cost + costs[at - taken[-1] - GRAM], (*taken, at)) for cost, taken in before)
            longer.append(min(ways, default=None))
        cheapest = longer
    whole = ((c[0] + costs[length - c[1][-1]], c[1]) for c in cheapest if c)
    return min(whole)[1]


def keys_of(word: str, gram_key) -> tuple[list[int], list[int]]:
    """Hashes of what a word's pivots are looked up by, and of what its prefix answers to.

    The edit is in the first segment: all behind it is equal; in the last: all before it;
    between the pivots: both. A word of many equal grams answers to the part up to a
    gram instead of all pairs of parts.
    """
    data, digest, length = memoryview(word.encode("utf-32-le", "surrogatepass")), xxhash.xxh3_64_intdigest, len(word)

    def head(end: int, mark: int = 1) -> int:
        return digest(data[: 4 * end], mark)

    def tail(start: int) -> int:
        return digest(data[4 * start :], 2)

    def both(end: int, start: int) -> int:
        return (head(end) * _ODD + tail(start)) & _MASK

    prefix = prefix_of([gram_key(word[at : at + GRAM]) for at in range(length - GRAM + 1)])
    first, second = pivots_of(prefix if len(prefix) <= PAIRED else [prefix[0], *prefix[-2:]], length)
    end = first + GRAM
    asked = [tail(end), head(second), both(end, second), head(end, 3)]
    held = [tail(at) for at in range(1, prefix[-1] + 1)] + [head(at) for at in range(prefix[0] + GRAM, length)]
    if len(prefix) <= PAIRED:
        held += [both(x + GRAM, y) for k, x in enumerate(prefix) for y in prefix[k + 1 :] if y >= x + GRAM]
    else:
        held += [head(at + GRAM, 3) for at in prefix]
    return asked, held


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows ``(a, a_n, b, b_n)``, ``a`` before ``b``: each two words that one edit tells apart, once.

    ``words`` are ``(word, n)``, each word once, of ``LETTERS`` letters at least.
    """
    counts = gram_counts(words)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, str]] = {}

        def gram_key(gram: str) -> tuple[int, str]:
            if gram not in known:
                if len(known) >= COUNTERS:
                    known.clear()
                known[gram] = (int(counts[zlib.crc32(gram.encode()) % COUNTERS]), gram)
            return known[gram]

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                of, asks, keys = [], [], []
                for k, word in enumerate(part.column(0).to_pylist()):
                    asked, held = keys_of(word, gram_key)
                    of += [k] * (len(asked) + len(held))
                    asks += [True] * len(asked) + [False] * len(held)
                    keys += asked + held
                rows = part.take(pa.array(of, pa.int64()))
                hashes = np.array(keys, np.uint64).view(np.int64)
                yield pa.record_batch(
                    [*rows.columns, pa.array(asks, pa.bool_()), pa.array(hashes)], ["word", "n", "asks", "key"]
                )

    rows = words.select("word", "n").mapInArrow(index, "word string, n bigint, asks boolean, key bigint")
    rows = written(rows.select("asks", "key", F.char_length("word").alias("size"), "word", "n"), "grams")
    # Lengths differ by one at most.
    near = F.explode(F.array(*[F.col("size") + d for d in (-1, 0, 1)])).alias("size")
    asked = rows.where("asks").select("key", near, F.col("word").alias("w"), F.col("n").alias("w_n"))
    held = rows.where("NOT asks").drop("asks")
    apart = F.levenshtein("w", "word", EDITS) == EDITS
    met = asked.join(held, ["key", "size"]).where(apart)
    first = F.col("w") < F.col("word")
    ends = [("a", "w", "word"), ("a_n", "w_n", "n"), ("b", "word", "w"), ("b_n", "n", "w_n")]
    return met.select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for name, x, y in ends]).distinct()


def roots(links: DataFrame) -> DataFrame:
    """Rows ``(word, root)`` for each of ``links (word, form)``: the end of the chain of forms.

    Each round joins the chains end to end, which doubles what they span. A form occurs at
    least twice as often as its word, so chains are short and never closed.
    """
    chains = written(links.select("word", F.col("form").alias("root")), "chains")
    while True:
        on = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(chains.join(on, "root", "left"), "chains")
        if longer.where("next IS NOT NULL").isEmpty():
            return chains
        chains = longer.select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame) -> DataFrame:
    """Rows ``(word, n, n_near, form, form_n, root)``, one for each of ``words (word, n)``.

    ``n_near`` counts the words that differ by exactly one letter put in, left out or
    replaced. ``form`` is the one of them that occurs most, the first in code-point order
    of several, if at least twice as often as the word; else null. ``root`` is where the
    forms lead to, the word itself if it has none. No words give no rows.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = written(near_pairs(words), "near")
    both = pairs.unionAll(pairs.select("b", "b_n", "a", "a_n")).toDF("word", "n", "other", "other_n")
    most = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("most")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), most)
    stronger = -F.col("most.less") >= 2 * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(stronger, F.col("most.other")).alias("form"),
        F.when(stronger, -F.col("most.less")).alias("form_n"),
    )
    forms = written(forms, "forms")
    ends = roots(forms.where("form IS NOT NULL"))
    return forms.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
