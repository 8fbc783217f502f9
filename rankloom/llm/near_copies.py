"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First SimHash: texts whose fingerprints are connected within ``RADIUS`` bits make a group, by the
index in Gray order, and within a group the whole sets are compared.

No radius finds all pairs: they differ in up to 17 bits on the sample tables, and with a radius of
that size no block of bits selects anything. So what fingerprints leave open is settled exactly.
A set that is alike to another lacks at most a fifth of its shingles there. On a
third of all shingles' hashes, texts are ruled out in which more than a fifth of the whole
set is found there and in no other text. The shingles of the texts left are put in order, rare
ones first. Two sets that are alike share a shingle among the first fifth of both. Texts that share
one of those, and are of like size, are tied into groups. A group that SimHash has connected
already needs nothing more; in the others the whole sets are compared.

A text that is found alike to one is looked at once itself and then left out,
so a large group of copies isn't compared pair by pair. No step loses a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import whole_text, written
from rankloom.llm.components import components, least_of_each
from rankloom.llm.simhash import _STEP, SEED, _shingles, near_links, print_of

#: Texts whose keys are sent to every executor.
SENT_TEXTS = 1_000_000
#: Bits in which fingerprints that link may differ.
RADIUS = 3
#: Texts are first ruled out on the hashes that this divides.
DRAWN = 3
#: Shingles in a share of a group; a group of more is dealt out.
SHARE = 1 << 20
_PART = np.dtype([("low", "<u4"), ("high", "<u2"), ("node", "<i8")])
_HELD = np.dtype([("hash", "<u8"), ("texts", "<i4")])
_ENTRY = np.dtype([("hash", "<u8"), ("node", "<i8"), ("size", "<i4")])


def _set(text: bytes | None, words_each: int) -> np.ndarray:
    """Hashes of a text's different shingles, in order."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in _shingles(text or b"", words_each)], "<u8"))


def _least_shared(size, similarity: float):
    """So many shingles of a set are in another that is alike."""
    return np.ceil(similarity * size - 1e-9).astype(np.int64)


def _keys(docs: DataFrame, words_each: int) -> DataFrame:
    """Rows ``(doc_id, text_key, node, check, print, size, drawn)``; texts with equal sets have one ``node``."""
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, checks, prints, sizes, drawn = [], [], [], [], []
            for text in batch.column(2):
                hashes = _set(text.as_py(), words_each)
                nodes.append(_node(hashes))
                checks.append(_check(hashes))
                prints.append(print_of(hashes[at : at + _STEP] for at in range(0, len(hashes), _STEP)))
                sizes.append(len(hashes))
                drawn.append(int(np.count_nonzero(hashes % np.uint64(DRAWN) == 0)))
            made = [pa.array(c, pa.int64()) for c in (nodes, checks, prints)]
            made += [pa.array(c, pa.int32()) for c in (sizes, drawn)]
            columns = [batch.column(0), batch.column(1), *made]
            yield pa.record_batch(columns, ["doc_id", "text_key", "node", "check", "print", "size", "drawn"])

    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, node bigint, check bigint, print bigint, size int, drawn int")


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _check(hashes: np.ndarray) -> int:
    """A second hash of a set, that tells sets of one node apart."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def _apart(keys: DataFrame) -> dict[tuple[int, int], int]:
    """New nodes for sets whose node another set has, by node and check.

    Of n different sets about n * n / 2^65 are such: three among 10^10.
    """
    checks = keys.groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most"))
    checks = written(checks.where("least != most").select("node", "least"), "near-checks")
    if checks.isEmpty():
        return {}
    odd = keys.join(F.broadcast(checks), "node").where("check != least").select("node", "check").distinct().collect()
    return {(r.node, r.check): xxhash.xxh3_64_intdigest(f"{r.node} {r.check}") - (1 << 63) for r in odd}


def _with_apart(keys: DataFrame, apart: dict[tuple[int, int], int]) -> DataFrame:
    if not apart:
        return keys
    new = keys.sparkSession.createDataFrame([(*k, v) for k, v in apart.items()], "node bigint, check bigint, new bigint")
    return keys.join(F.broadcast(new), ["node", "check"], "left").withColumn("node", F.coalesce("new", "node")).drop("new")


def _by_bucket(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """The entries of one bucket after another, from rows sorted by bucket."""
    last, parts = None, []
    for batch in batches:
        for k, to in enumerate(batch.column(0).to_pylist()):
            if to != last and parts:
                yield np.concatenate(parts)
                parts = []
            last = to
            parts.append(np.frombuffer(batch.column(1)[k].as_py(), kind))
    if parts:
        yield np.concatenate(parts)


def _dealt(to: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(to, kind="stable")
    to, entries = to[order], entries[order]
    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)])
    contents = [part.tobytes() for part in np.split(entries, cuts[1:])] if len(to) else []
    return pa.record_batch([pa.array(to[cuts], pa.int32()), pa.array(contents, pa.binary())], ["bucket", "content"])


def _buckets(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _held(texts: DataFrame, words_each: int, divisor: int, apart: dict[tuple[int, int], int]) -> DataFrame:
    """Rows ``(node, held, content)``: the shingles, among those drawn, that other texts have too.

    Many rows a node. Hashes are cut to 48 bits besides the bucket's; two that agree by chance
    count as one shingle that is shared, which rules nothing out.
    """
    buckets = _buckets(texts.sparkSession)
    with_content = divisor == 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                sets = [_set(text.as_py(), words_each) for text in whole.column(0).slice(at, 2048)]
                nodes = np.array([_node(own) for own in sets], np.int64)
                if apart:
                    known = ((node, _check(own)) for node, own in zip(nodes.tolist(), sets))
                    nodes = np.array([apart.get(both, both[0]) for both in known], np.int64)
                drawn = [own[own % np.uint64(divisor) == 0] for own in sets]
                hashes = np.concatenate([*drawn, np.zeros(0, "<u8")])
                entries = np.empty(len(hashes), _PART)
                entries["low"], entries["high"] = hashes >> np.uint64(16) & np.uint64(0xFFFFFFFF), hashes >> np.uint64(48)
                entries["node"] = np.repeat(nodes, [len(own) for own in drawn])
                yield _dealt((hashes % np.uint64(1 << 16) % np.uint64(buckets)).astype(np.int32), entries)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in _by_bucket(batches, _PART):
            hashes = entries["low"].astype("<u8") | entries["high"].astype("<u8") << np.uint64(32)
            order = np.argsort(hashes, kind="stable")
            hashes, nodes = hashes[order], entries["node"][order]
            starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            sizes = np.diff(np.r_[starts, len(hashes)])
            many = np.repeat(sizes, sizes)
            shared = many > 1
            held = np.empty(int(shared.sum()), _HELD)
            held["hash"], held["texts"], nodes = hashes[shared], many[shared], nodes[shared]
            order = np.argsort(nodes, kind="stable")
            held, nodes = held[order], nodes[order]
            cuts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]][: len(nodes)])
            counts = np.diff(np.r_[cuts, len(nodes)])
            contents = pa.nulls(len(cuts), pa.binary())
            if with_content and len(cuts):
                contents = pa.array([part.tobytes() for part in np.split(held, cuts[1:])], pa.binary())
            yield pa.record_batch([pa.array(nodes[cuts]), pa.array(counts), contents], ["node", "held", "content"])

    dealt = texts.select(whole_text().cast("binary").alias("text")).mapInArrow(deal, "bucket int, content binary")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, "node bigint, held bigint, content binary")


def _fronts(held: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """Rows ``(node, size, front)``: of the shingles in order the first, of which alike sets share one."""
    whole = held.groupBy("node").agg(F.collect_list("content").alias("contents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fronts = []
            for size, contents in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = np.frombuffer(b"".join(contents), _HELD)
                # Shingles of no other text are the first in the order; they tie nothing.
                take = len(own) - int(_least_shared(np.array(size), similarity)) + 1
                own = own[np.lexsort((own["hash"], own["texts"]))][: max(take, 0)]
                fronts.append(own["hash"].tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fronts, pa.binary())], ["node", "size", "front"])

    joined = sizes.join(whole, "node").select("node", "size", "contents")
    return joined.mapInArrow(run, "node bigint, size int, front binary").where("octet_length(front) > 0")


def _ties(fronts: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that connect all nodes of like size with a shingle in both fronts."""
    buckets = _buckets(fronts.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(front, "<u8") for front in batch.column(2).to_pylist()]
            lengths = [len(part) for part in parts]
            entries = np.empty(sum(lengths), _ENTRY)
            entries["hash"] = np.concatenate([*parts, np.zeros(0, "<u8")])
            entries["node"] = np.repeat(batch.column(0).to_numpy(), lengths)
            entries["size"] = np.repeat(batch.column(1).to_numpy(), lengths)
            yield _dealt((entries["hash"] % np.uint64(buckets)).astype(np.int32), entries)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in _by_bucket(batches, _ENTRY):
            entries = entries[np.lexsort((entries["node"], entries["size"], entries["hash"]))]
            left, right = entries[:-1], entries[1:]
            # Of two sizes that fit each other, all between them do: neighbours connect them.
            tied = (left["hash"] == right["hash"]) & (left["node"] != right["node"])
            tied &= left["size"] >= similarity * right["size"] - 1e-9
            pairs = np.stack([left["node"][tied], right["node"][tied]], axis=1)
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = fronts.select("node", "size", "front").mapInArrow(deal, "bucket int, content binary")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tie, "a bigint, b bigint")


def _alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the first one that it is connected with by pairs that are alike."""
    sizes = np.array([len(s) for s in sets])
    bounds = np.r_[0, np.cumsum(sizes)]
    names, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    first, waiting = np.arange(len(sets)), np.ones(len(sets), bool)
    indexed = 2 * len(sets) + 1
    for root in range(len(sets)):
        if not waiting[root]:
            continue
        waiting[root] = False
        reached = [root]
        while reached:
            left = int(waiting.sum())
            if not left:
                break
            if 2 * left < indexed:  # the sets that wait, by shingle
                live = waiting[owner]
                order = np.argsort(column[live], kind="stable")
                holders = owner[live][order]
                starts = np.r_[0, np.cumsum(np.bincount(column[live], minlength=len(names)))]
                indexed = left
            at = reached.pop()
            own = column[bounds[at] : bounds[at + 1]]
            low, many = starts[own], starts[own + 1] - starts[own]
            places = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            shared = np.bincount(holders[places], minlength=len(sets))
            near = waiting & (shared >= similarity * (sizes[at] + sizes - shared) - 1e-9)
            found = np.flatnonzero(near)
            waiting[found] = False
            first[found] = root
            reached += found.tolist()
    return first


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the ``text`` that its ``doc_id`` and ``text_key`` name."""
    if wanted.count() <= SENT_TEXTS:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))
    return rows.alias("a").join(wanted.alias("b"), same).select("b.*", "text")


def _near_prints(keys: DataFrame) -> DataFrame:
    """Rows ``(node, component)`` of the nodes whose fingerprints are connected with another's."""
    nodes = keys.where("size > 0").select("node", "print").distinct()
    prints = written(nodes.groupBy("print").agg(F.min("node").alias("id")), "near-prints")
    found = written(components(near_links(prints, RADIUS)), "near-print-ties")
    named = prints.join(found, prints["id"] == found["node"], "left")
    named = nodes.join(named.select("print", F.coalesce("component", "id").alias("component")), "print")
    named = written(named.select("node", "component"), "near-print-groups")
    several = named.groupBy("component").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    return named.join(several.select("component"), "component", "left_semi")


def _links(docs: DataFrame, keys: DataFrame, words_each: int, similarity: float, apart: dict) -> DataFrame:
    """Links ``(a, b)`` that connect nodes as the pairs of alike sets do."""
    one = F.min(F.struct("doc_id", "text_key")).alias("one")
    nodes = keys.where("size > 0").groupBy("node", "size", "drawn").agg(one)
    nodes = written(nodes.select("node", "size", "drawn", "one.*"), "near-nodes")
    first = written(nodes.drop("drawn").join(_near_prints(keys), "node"), "near-first")
    sure = written(components(_compared(docs, first, words_each, similarity)), "near-sure")

    counted = _held(docs, words_each, DRAWN, apart).groupBy("node").agg(F.sum("held").alias("held"))
    may_lack = F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9)
    left = nodes.join(counted, "node", "left").where(F.coalesce("held", F.lit(0)) >= F.col("drawn") - may_lack)
    left = written(left.select("node", "size", "doc_id", "text_key"), "near-left")
    held = _held(_texts(docs, left), words_each, 1, apart)
    fronts = _fronts(held, left.select("node", "size"), similarity)
    found = written(components(_ties(written(fronts, "near-fronts"), similarity)), "near-ties")
    both = found.unionAll(found.select(F.col("component").alias("node"), "component").distinct())
    known = sure.select("node", F.col("component").alias("known"))
    groups = left.join(both, "node").join(known, "node", "left").withColumn("known", F.coalesce("known", "node"))
    groups = written(groups, "near-groups")
    open_ = groups.groupBy("component").agg(F.min("known").alias("low"), F.max("known").alias("high"))
    open_ = written(open_.where("low != high").select("component"), "near-open")
    rest = _compared(docs, groups.drop("known").join(open_, "component"), words_each, similarity)
    return rest.unionAll(sure.select(F.col("node").alias("a"), F.col("component").alias("b")))


def _compared(docs: DataFrame, wanted: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that connect what pairs of alike sets connect in the groups of ``wanted``.

    ``wanted`` has ``node, size, doc_id, text_key, component``; it is read several times.
    """
    large = wanted.groupBy("component").agg(F.ceil(F.sum("size") / SHARE).cast("int").alias("shares"))
    large = written(large.where("shares > 1"), "near-shares")
    shares = F.coalesce("shares", F.lit(1)).alias("shares")
    wanted = wanted.join(large, "component", "left").select("node", "component", "doc_id", "text_key", shares)
    texts = _texts(docs, written(wanted, "near-wanted"))
    own, other = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    cells = texts.select("node", "component", F.col("text").cast("binary").alias("text"), own.alias("own"), other.alias("other"))
    cells = cells.select(
        F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> pa.RecordBatch:
            to = np.array(nodes, np.int64)[_alike(sets, similarity)]
            return pa.record_batch([pa.array(nodes, pa.int64()), pa.array(to)], ["a", "b"])

        nodes: list[int] = []
        sets: list[np.ndarray] = []
        last = None
        for batch in batches:
            for cell, node, text in zip(*(column.to_pylist() for column in batch.columns)):
                if cell != last and nodes:
                    yield links()
                    nodes, sets = [], []
                last = cell
                nodes.append(node)
                sets.append(_set(text, words_each))
        if nodes:
            yield links()

    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "a bigint, b bigint").where("a != b")


def one_of_each(docs: DataFrame, words_each: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies of a smaller ``doc_id``, with all their columns.

    Two texts are near copies if the sets of their shingles (white-space words in ASCII
    lower case, ``words_each`` of them, all words of a shorter text) have a Jaccard similarity
    of ``similarity`` or more, or are both empty. Of texts connected by such pairs the row with the
    smallest ``doc_id`` stays, a null id comes last, then the hash of the text decides; rows
    that repeat id and text count as one. An id's other texts are judged on their own.
    """
    keys = written(_keys(docs, words_each), "near-keys")
    apart = _apart(keys)
    keys = _with_apart(keys, apart)
    found = components(_links(docs, keys, words_each, similarity, apart)).select("node", F.col("component").alias("first"))
    labels = keys.select("doc_id", "text_key", "node").join(written(found, "near-components"), "node", "left")
    return least_of_each(docs, labels.select("doc_id", "text_key", F.coalesce("first", "node").alias("component")))
