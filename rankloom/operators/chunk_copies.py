"""Chunks that say the same: MinHash signatures, banded lookup and exact verification.

Equal texts are one text first. Of the others each has a signature: for many hash functions
the least hash of its word shingles. Two texts agree in one place of their signatures with
the probability of their Jaccard similarity, so of two that are alike some band of
places is equal almost surely: with the defaults five pairs in a million of similarity 0.8 are
missed, and fewer above. What shares a band is compared shingle by shingle.

A band may hold very many texts. They are first compared with one of them only, so a large
group of copies costs one comparison each. Those that are not connected then are compared
with the others of their band that are still apart, in shares of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.idfilter import passing, wanted_bits
from rankloom.session import settle, settle_round

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
SEED = 7
#: Texts of one band that are compared in one place; of larger bands each share of so many is one.
SHARE = 2000


#: Buckets of bands for each shuffle partition; a task compares one at a time.
BUCKETS = 16
#: Texts whose signatures are made at a time.
_SLICE = 1024
_ENTRY = np.dtype([("band", np.uint64), ("size", np.int32), ("sure", np.bool_), ("key", np.bytes_, 16)])


def _mixed(values: np.ndarray) -> np.ndarray:
    """A permutation of 64 bits in which each bit depends on all."""
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(32))


def _odd(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(texts: list[bytes], words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each text, ascending, one text after another, and how many each text has.

    Words are hashed once; a run's hash is a sum of its words' hashes, each weighted by its place.
    """
    words = [text.split() for text in texts]
    counts = np.array([len(own) for own in words], np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, counts.sum())
    runs = np.where(counts > 0, np.maximum(1, counts - words_each + 1), 0)
    text = np.repeat(np.arange(len(texts)), runs)
    ends = np.cumsum(counts)
    at = np.arange(len(text)) + np.repeat(ends - counts - (np.cumsum(runs) - runs), runs)
    weights = _odd(words_each, SEED + 1)
    sums = np.zeros(len(hashes), np.uint64)
    for place, weight in enumerate(weights[: len(hashes)]):
        sums[: len(hashes) - place] += hashes[place:] * weight
    values = sums[at]
    short = np.flatnonzero(at + words_each > ends[text])
    values[short] = 0
    for place, weight in enumerate(weights):
        there = short[at[short] + place < ends[text[short]]]
        values[there] += hashes[at[there] + place] * weight
    values = _mixed(values)
    stops = np.cumsum(runs)
    for start, stop in zip((stops - runs).tolist(), stops.tolist()):
        values[start:stop].sort()
    fresh = np.ones(len(text), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[fresh], np.bincount(text[fresh], minlength=len(texts))


def shingles_of(text: bytes, words_each: int = WORDS) -> np.ndarray:
    """Hashes of the different runs of so many words, in order; all words of a shorter text."""
    return _shingles([text], words_each)[0]


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def _bands(shingles: np.ndarray, sizes: np.ndarray, factors: np.ndarray, terms: np.ndarray, rows: int) -> np.ndarray:
    """A row of band hashes for each text; ``rows`` least hashes make a band.

    32 bits of a shingle are permuted: two that share them can only make a band agree that would not.
    """
    least = np.full((len(sizes), len(factors)), np.uint32(2**32 - 1))
    short = shingles.astype(np.uint32)
    ends = np.cumsum(sizes)
    for text, (start, end) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
        for at in range(start, end, 4096):
            hashes = short[at : min(end, at + 4096), None] * factors
            hashes += terms
            np.minimum(least[text], hashes.min(axis=0), out=least[text])
    parts = least.reshape(len(sizes), -1, rows).astype(np.uint64)
    return _mixed((parts * _odd(rows, SEED + 2)).sum(axis=2, dtype=np.uint64) + _odd(parts.shape[1], SEED + 3))


def bands_of(shingles: np.ndarray, factors: np.ndarray, terms: np.ndarray, rows: int = ROWS) -> list[int]:
    """The band hashes of one text."""
    return _bands(shingles, np.array([len(shingles)]), factors, terms, rows)[0].view(np.int64).tolist()


def _signed(words_each: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, text)`` as ``(key, size, bands)``, the bands' hashes as bytes, none for a text without words.

    Equal texts of a batch are one.
    """
    factors, terms = _functions(BANDS * ROWS)
    for batch in batches:
        texts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        # Of bytes only ASCII letters are lowered.
        bodies, sizes, bands = [text.lower() for text in texts.values()], [], []
        for at in range(0, len(bodies), _SLICE):
            shingles, counts = _shingles(bodies[at : at + _SLICE], words_each)
            hashes = _bands(shingles, counts, factors, terms, ROWS)
            bands += [own.tobytes() if count else b"" for own, count in zip(hashes, counts)]
            sizes += counts.tolist()
        columns = [pa.array(list(texts), pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.binary())]
        yield pa.record_batch(columns, ["key", "size", "bands"])


def _sets(words_each: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, text)`` as ``(key, size, shingles)``."""
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            batch = whole.slice(at, _SLICE)
            shingles, sizes = _shingles([text.lower() for text in batch.column(1).to_pylist()], words_each)
            starts = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            sets = pa.ListArray.from_arrays(starts, pa.array(shingles.view(np.int64)))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int32()), sets], ["key", "size", "shingles"])


def _dealt(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(bucket, entries, met)``: bands in packed form, dealt by their hash.

    Of the texts that share a band within a batch only one goes to the band's bucket, marked as
    not alone. The others need no more comparison and go along anywhere.
    """
    for batch in batches:
        table = pa.Table.from_batches([batch]).filter(pc.greater(pc.binary_length(batch.column("bands")), 0))
        if not table.num_rows:
            continue
        keys, sizes = table["key"].to_pylist(), table["size"].to_numpy()
        bands = np.frombuffer(b"".join(table["bands"].to_pylist()), np.uint64)
        each = len(bands) // len(keys)
        order = np.argsort(bands, kind="stable")
        entries = np.zeros(len(bands), _ENTRY)
        entries["band"] = bands[order]
        entries["size"] = sizes[order // each]
        entries["key"] = np.array(keys, _ENTRY["key"])[order // each]
        same = entries["band"][1:] == entries["band"][:-1]
        entries["sure"][1:] = same
        entries["sure"][:-1] |= same
        head = np.r_[True, ~same]
        lone, met = entries[head], entries[~head]
        place = ((lone["band"] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        cuts = np.r_[starts, len(lone)].tolist()
        parts = [lone[start:end].tobytes() for start, end in zip(cuts, cuts[1:])]
        shares = np.linspace(0, len(met), len(parts) + 1).astype(int).tolist()
        along = [met[start:end].tobytes() for start, end in zip(shares, shares[1:])]
        columns = [pa.array(place[starts].astype(np.int32)), pa.array(parts, pa.binary()), pa.array(along, pa.binary())]
        yield pa.record_batch(columns, ["bucket", "entries", "met"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(band, key, size)`` of the bands that several texts have; buckets come one after another."""

    def rows(found: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(found), 8192):
            part = found[at : at + 8192]
            keys = np.ascontiguousarray(part["key"]).view(np.uint8)
            keys = pa.Array.from_buffers(pa.binary(16), len(part), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
            bands = pa.array(np.ascontiguousarray(part["band"]).view(np.int64))
            yield pa.record_batch([bands, keys, pa.array(part["size"])], ["band", "key", "size"])

    def several(parts: list[bytes]) -> np.ndarray:
        entries = np.frombuffer(b"".join(parts), _ENTRY)
        entries = entries[np.argsort(entries["band"], kind="stable")]
        same = entries["band"][1:] == entries["band"][:-1]
        keep = entries["sure"].copy()
        keep[1:] |= same
        keep[:-1] |= same
        # Equal texts of several batches are still there as often, and alone if nothing else is.
        found = entries[keep]
        found = found[np.lexsort((found["key"], found["band"]))]
        head = np.flatnonzero(np.r_[True, found["band"][1:] != found["band"][:-1]][: len(found)])
        if not len(head):
            return found
        other = np.r_[False, found["key"][1:] != found["key"][:-1]]
        other[head] = False
        several = np.logical_or.reduceat(other | found["sure"], head)
        return found[np.repeat(several, np.diff(np.r_[head, len(found)]))]

    held, parts = None, []
    for batch in batches:
        for bucket, entries, met in zip(*(column.to_pylist() for column in batch.columns)):
            yield from rows(np.frombuffer(met, _ENTRY))
            if bucket != held and parts:
                yield from rows(several(parts))
                parts = []
            held = bucket
            parts.append(entries)
    if parts:
        yield from rows(several(parts))


def _members(rows: DataFrame, signed: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows ``(band, key, size)``: the texts of each band that several texts have.

    ``signed`` makes batches ``(key, size, bands)`` of those of ``rows``. Nearly all bands are one
    text's. So they are exchanged once, packed, and only the others become rows.
    """
    buckets = BUCKETS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt(buckets, signed(batches))

    packed = rows.mapInArrow(dealt, "bucket int, entries binary, met binary")
    in_turn = packed.repartition("bucket").sortWithinPartitions("bucket")
    return in_turn.mapInArrow(_met, "band bigint, key binary, size int").distinct()


def _alike(pairs: DataFrame, signatures: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs (a, b)`` whose sets of shingles are alike."""
    for end in ("a", "b"):
        own = signatures.select(F.col("key").alias(end), F.col("size").alias(f"{end}_size"), F.col("shingles").alias(f"{end}_set"))
        pairs = pairs.join(own, end)
    shared = F.size(F.array_intersect("a_set", "b_set"))
    either = F.col("a_size") + F.col("b_size") - shared
    return pairs.where(shared >= F.lit(similarity) * either - 1e-9).select("a", "b")


def connected(links: DataFrame) -> DataFrame:
    """Rows ``(node, label)`` of the nodes of ``links (a, b)``: the least node they are connected with.

    Each round takes the least label among a node's neighbours, and then the label of that
    label, so the number of rounds grows with the logarithm of a group's width.
    """
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settle_round(both)
    labels = settle_round(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(least, "node").select("node", F.least("label", "near").alias("to"), "label")
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        moved = settle_round(moved.join(jump, "to").select("node", F.least("to", "further").alias("to"), "label"))
        labels = moved.select("node", F.col("to").alias("label"))
        if moved.where("to != label").isEmpty():
            return labels


def _first_pairs(members: DataFrame) -> DataFrame:
    """Every member of a band with the band's least one."""
    least = members.groupBy("band").agg(F.min("key").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = members.join(least, "band").where("key != a")
    return met.select("a", F.col("key").alias("b")).distinct()


def _other_pairs(members: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Members that are apart from the least of their band, with all others that are apart from them."""
    named = members.join(labels.withColumnRenamed("node", "key"), "key", "left")
    named = settle(named.withColumn("label", F.coalesce("label", "key")))
    bands = named.groupBy("band").agg(
        F.min_by("label", "key").alias("first"), F.min("key").alias("least"),
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"),
    )
    shares = F.ceil(F.col("n") / SHARE).cast("int").alias("shares")
    bands = settle(bands.where("low != high").select("band", "first", "least", shares))
    inside = named.join(bands, "band")
    apart = (F.col("label") != F.col("first")).alias("apart")
    own = F.pmod(F.xxhash64("key"), F.col("shares")).cast("int").alias("share")
    right = inside.select("band", own, F.col("key").alias("b"), F.col("label").alias("b_label"), F.col("size").alias("b_size"), apart, "least")
    every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    left = inside.where(F.col("label") != F.col("first")).select(
        "band", every, F.col("key").alias("a"), F.col("label").alias("a_label"), F.col("size").alias("a_size")
    )
    fits = (F.least("a_size", "b_size") >= F.lit(similarity) * F.greatest("a_size", "b_size") - 1e-9)
    once = ~F.col("apart") | (F.col("a") < F.col("b"))
    met = left.join(right, ["band", "share"]).where((F.col("a_label") != F.col("b_label")) & fits & once & (F.col("b") != F.col("least")))
    return met.select("a", "b").distinct()


def chunk_copies(
    pieces: DataFrame, ids: list[str], text: str, similarity: float = SIMILARITY, words_each: int = WORDS
) -> DataFrame:
    """Rows ``(*ids, first, copies, kept)``, one for each of ``pieces``.

    Pieces are of one class if they are connected by pairs of equal text, or of a Jaccard
    similarity of ``similarity`` or more between their sets of ``words_each`` words (ASCII
    lower case, between white space). ``first`` holds the least ``ids`` of the class,
    ``copies`` its number of pieces, and ``kept`` marks the first. A null text counts as
    empty; texts without words are alike only if they are equal. Rows that repeat their
    ids are all of the class, and all kept if the first is one of them. No pieces give no rows.
    """
    member = F.struct(*ids)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.unhex(F.md5(body.cast("binary"))).alias("key")
    texts = pieces.select(key, body.cast("binary").alias("text"))
    members = settle(_members(texts, partial(_signed, words_each)))
    # Most texts share no band, and are not sent.
    several = settle(members.select("key").distinct())
    wanted = passing(texts, ["key"], wanted_bits(several, ["key"])).distinct().join(several, "key")
    signatures = settle(wanted.mapInArrow(partial(_sets, words_each), "key binary, size int, shingles array<bigint>"))
    near = settle(_alike(_first_pairs(members), signatures, similarity))
    rest = _alike(_other_pairs(members, connected(near), similarity), signatures, similarity)
    labels = settle(connected(near.unionAll(rest)))
    named = pieces.select(member.alias("member"), key).join(labels.withColumnRenamed("node", "key"), "key", "left")
    named = settle(named.select("member", F.coalesce("label", "key").alias("class")))
    classes = settle(named.groupBy("class").agg(F.min("member").alias("first"), F.count(F.lit(1)).alias("copies")))
    found = named.join(classes, "class")
    return found.select("member.*", "first", "copies", (F.col("member") == F.col("first")).alias("kept"))
