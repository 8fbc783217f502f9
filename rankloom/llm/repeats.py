"""Byte strings that repeat across documents, by a family of sorted suffix arrays.

Strings of ``WIDTH`` bytes are compared, one for each start. Of a string's inner grams
that with the least hash is its anchor, so equal strings have their anchors at the same
place. Consecutive strings with one anchor form a run. The suffixes at anchors, with
their runs, are all that is indexed: a sparse suffix array, sorted by the anchor gram's
hash and a hash of the run's bytes.

A batch of texts becomes one such array. Arrays are dealt out by key to buckets, and each
bucket keeps a family of arrays: a new one is scanned against every level for equal
runs, of which the earlier place stays, and levels of like size are merged, so that sizes
grow geometrically. A run that equals an earlier one is removed whole. Anchors whose runs
differ are settled string by string, by a hash of each; this concerns the runs at the
ends of repeated passages.

Identities are hashes of 128 bits or more (64 of the anchor gram, 64 of the run or string).
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import arrow_schema, flat_bytes, whole_text, with_id, written

WIDTH, GRAM = 100, 32
#: Runs of one batch's array.
BATCH_RUNS = 300_000
#: Runs of one anchor gram in a batch from which on they skip the index and are settled one by one.
CROWDED = 4
#: Runs of one anchor gram that are settled in one place; more are dealt out by string.
SHARE = 20_000
_BLOCK = 1 << 20
# Fixed: the mixing constants of a 64-bit hash.
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

_RUN = np.dtype([
    ("key", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("lead", "u1"), ("size", "u1"),
])
_HASHED = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("size", "u1")])


def _least_in_window(keys: np.ndarray, width: int) -> np.ndarray:
    least, reach = keys, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from each place on; ``width`` is a power of two."""
    hashes, reach, factor = data.astype(np.uint64) + np.uint64(1), 1, _FACTOR
    while reach < width:
        hashes = hashes[:-reach] * factor + hashes[reach:]
        factor, reach = factor * factor, 2 * reach
    hashes ^= hashes >> np.uint64(29)
    hashes *= _MIX
    return hashes ^ (hashes >> np.uint64(32))


def _block_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Runs of the texts at ``data[starts[i]:ends[i]]``; ``doc`` is the text's number."""
    long_ = np.flatnonzero(ends - starts >= WIDTH)
    if not len(long_):
        return np.zeros(0, _RUN)
    hashes = _gram_hashes(data, GRAM)
    place_bits = np.uint64(_BLOCK - 1)
    keyed = (hashes & ~place_bits) | np.arange(len(hashes), dtype=np.uint64)
    anchors = (_least_in_window(keyed, WIDTH - GRAM + 1) & place_bits).astype(np.int64)
    counts = ends[long_] - starts[long_] - WIDTH + 1
    owner = np.repeat(long_, counts)
    firsts = np.cumsum(counts) - counts
    at = np.repeat(starts[long_] - firsts, counts) + np.arange(counts.sum())
    anchor = anchors[at]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    sizes = np.diff(np.r_[new, len(at)])
    runs = np.zeros(len(new), _RUN)
    first = at[new]
    runs["key"], runs["doc"] = hashes[anchor[new]], owner[new]
    runs["start"], runs["lead"], runs["size"] = first - starts[owner[new]], anchor[new] - first, sizes
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    ends_at = (first + sizes + WIDTH - 1).tolist()
    runs["hash"] = [digest(view[a:b], lead) for a, b, lead in zip(first.tolist(), ends_at, runs["lead"].tolist())]
    return runs


def text_runs(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of texts that lie end to end, block by block; ``doc`` is the text's number.

    A text longer than a block is cut into overlapping pieces, so each string of it is in
    one run; where a run is cut, its strings are compared one by one.
    """
    row, rows = 0, len(bounds) - 1
    while row < rows:
        last = int(np.searchsorted(bounds, bounds[row] + _BLOCK - GRAM, side="right")) - 1
        if last > row:
            low = bounds[row]
            part = bounds[row : last + 1] - low
            runs = _block_runs(np.ascontiguousarray(data[low : bounds[last]]), part[:-1], part[1:])
            runs["doc"] += row
            yield runs
            row = last
            continue
        step = _BLOCK - 2 * WIDTH
        for cut in range(0, int(bounds[row + 1] - bounds[row]), step):
            low = bounds[row] + cut
            high = min(bounds[row + 1], low + step + WIDTH - 1)
            runs = _block_runs(np.ascontiguousarray(data[low:high]), np.array([0]), np.array([high - low]))
            runs["doc"], runs["start"] = row, runs["start"] + cut
            yield runs
        row += 1


def _sorted(runs: np.ndarray) -> np.ndarray:
    return runs[np.lexsort((runs["start"], runs["doc"], runs["hash"], runs["key"]))]


def _firsts(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted runs the first of each identity, and the others (but for the same place)."""
    if not len(runs):
        return runs, runs
    new = np.r_[True, (runs["key"][1:] != runs["key"][:-1]) | (runs["hash"][1:] != runs["hash"][:-1])]
    first = runs[np.flatnonzero(new)[np.cumsum(new) - 1]]
    elsewhere = (runs["doc"] != first["doc"]) | (runs["start"] != first["start"])
    return runs[new], runs[~new & elsewhere]


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` are among sorted distinct keys, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class _KeySet:
    """A growing set of keys as sorted arrays of geometric sizes."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for part in self.parts:
            out |= _places(part, keys)[1]
        return out

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.parts.append(np.unique(keys))
        while len(self.parts) > 1 and len(self.parts[-2]) < 2 * len(self.parts[-1]):
            self.parts[-2:] = [np.union1d(*self.parts[-2:])]


class Family:
    """Levels of runs sorted by key, each at least twice as long as the next.

    A key has one run in all levels. Keys with several different runs are marked; what is
    known of them is handed out as open, never looked at again, and left behind when its
    level is merged. A batch costs as much as the batch and its share of the merges.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # keys, runs
        self.marked = _KeySet()

    def add(self, runs: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scan a batch's sorted array against the levels; returns repeated runs and open ones.

        Keys in ``crowded`` are known to have several different runs.
        """
        runs, repeated = _firsts(runs)
        keys = runs["key"]
        several = np.union1d(crowded, keys[1:][keys[1:] == keys[:-1]])
        several = several[~self.marked.has(several)]
        gone, open_ = [repeated], []
        for known, level in self.levels:
            at, there = _places(known, several)
            open_.append(level[at[there]])
        self.marked.add(several)
        marked = self.marked.has(keys)
        open_.append(runs[marked])
        runs = runs[~marked]
        keys = np.ascontiguousarray(runs["key"])
        for known, level in self.levels:
            at, there = _places(known, keys)
            hit = np.flatnonzero(there)
            if not len(hit):
                continue
            old, new, place = level[at[hit]], runs[hit], at[hit]
            equal = old["hash"] == new["hash"]
            earlier = equal & ((new["doc"] < old["doc"]) | ((new["doc"] == old["doc"]) & (new["start"] < old["start"])))
            elsewhere = (new["doc"] != old["doc"]) | (new["start"] != old["start"])
            gone += [old[earlier], new[equal & ~earlier & elsewhere]]
            level[place[earlier]] = new[earlier]
            open_ += [new[~equal], old[~equal]]
            self.marked.add(keys[hit][~equal])
            runs, keys = np.delete(runs, hit), np.delete(keys, hit)
        self.levels.append((keys, runs))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            keys, runs = (np.concatenate(x) for x in zip(*self.levels[-2:]))
            live = np.flatnonzero(~self.marked.has(keys))
            order = live[np.argsort(keys[live], kind="stable")]
            self.levels[-2:] = [(keys[order], runs[order])]
        return np.concatenate(gone), np.concatenate(open_)


def _span_rows(docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Documents and their spans ``(start, end)`` of bytes, merged, as 32-bit numbers."""
    order = np.lexsort((starts, docs))
    docs, starts, sizes = docs[order], starts[order].astype(np.int64), sizes[order].astype(np.int64)
    ends = starts + sizes + WIDTH - 1
    if not len(docs):
        return docs, []
    # Ends grow along with starts but for runs within runs, so carry the largest within a document.
    new_doc = np.r_[True, docs[1:] != docs[:-1]]
    lift = (np.cumsum(new_doc) - 1) << np.int64(32)
    reach = np.maximum.accumulate(ends + lift) - lift
    new = new_doc | np.r_[True, starts[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    spans = np.stack([starts[first], reach[np.r_[first[1:], len(docs)] - 1]], axis=1).astype("<u4")
    owner = docs[first]
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return owner[cuts], [s.tobytes() for s in np.split(spans, cuts[1:])]


_DEALT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("content", pa.binary())])
_INDEX, _SPANS, _OPEN, _CROWD = range(4)


def _rows(bucket, kind: int, docs, contents) -> pa.RecordBatch:
    n = len(contents)
    columns = [np.full(n, bucket, np.int32) if np.isscalar(bucket) else bucket, np.full(n, kind, np.int32), docs]
    return pa.record_batch([*(pa.array(c) for c in columns), pa.array(contents, pa.binary())], schema=_DEALT)


def _dealt(docs: DataFrame, buckets: int) -> DataFrame:
    """What each batch of texts sends: runs by bucket, settled spans, open runs, crowded keys."""
    rows = docs.select("doc_id", whole_text().cast("binary").alias("text"))

    def send(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        runs, repeated = _firsts(_sorted(np.concatenate(parts)))
        owners, spans = _span_rows(repeated["doc"], repeated["start"], repeated["size"])
        if len(spans):
            yield _rows((owners % buckets).astype(np.int32), _SPANS, owners, spans)
        new = np.flatnonzero(np.r_[True, runs["key"][1:] != runs["key"][:-1]]) if len(runs) else np.zeros(0, np.int64)
        many = np.diff(np.r_[new, len(runs)])
        crowd = np.repeat(many > CROWDED, many)
        bucket = (runs["key"] % np.uint64(buckets)).astype(np.int32)
        for kind, some in ((_OPEN, np.flatnonzero(crowd)), (_INDEX, np.flatnonzero(~crowd))):
            # Open runs go anywhere; the others to the bucket of their key.
            to = (runs["hash"][some] % np.uint64(buckets)).astype(np.int32) if kind == _OPEN else bucket[some]
            some = some[np.argsort(to, kind="stable")]
            to = np.sort(to)
            cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
            contents = [runs[s].tobytes() for s in np.split(some, cuts[1:])] if len(to) else []
            if contents:
                yield _rows(to[cuts], kind, np.zeros(len(cuts), np.int64), contents)
        keys = runs["key"][new][many > CROWDED]
        if len(keys):
            to = (keys % np.uint64(buckets)).astype(np.int32)
            yield _rows(to, _CROWD, np.zeros(len(keys), np.int64), [k.tobytes() for k in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros(0, _RUN)], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for runs in text_runs(*flat_bytes(batch.column(1))):
                runs["doc"] = ids[runs["doc"]]
                held.append(runs)
                size += len(runs)
                if size >= BATCH_RUNS:
                    yield from send(held)
                    held, size = [np.zeros(0, _RUN)], 0
        yield from send(held)

    return rows.mapInArrow(run, "bucket int, kind int, doc_id bigint, content binary")


def in_order(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, id, text)`` whose ``doc_id`` is one row's only, in the order of the ids.

    Where all ids tell rows apart they are taken as they are. Else rows are numbered by id,
    null last, then by a hash of the text, then as they come: in ranges of that order, whose
    sizes are added up, so no task holds all rows of an id. The texts are written once for it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))
    several = rows.groupBy("id").count().where("count > 1 OR id IS NULL")
    if several.isEmpty():
        return rows.select(F.col("id").alias("doc_id"), "id", "text")
    order = [F.col("id").isNull(), F.col("id"), F.col("hash"), F.col("row")]
    rows = rows.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    # Written first: sorted ranges are cut by a sample, and rows have to stay what they were then.
    rows = written(rows, "rows").repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    placed = written(rows.select("range", place.alias("place"), "id", "text"), "placed")
    upto = F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    before = placed.groupBy("range").count().select("range", F.coalesce(upto, F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "range").select(
        (F.col("before") + F.col("place")).alias("doc_id"), "id", "text"
    )


_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("lead", pa.int32()), ("size", pa.int32()),
    ("spans", pa.binary()),
])


def _found(dealt: DataFrame) -> DataFrame:
    """Settled spans, and open runs with ``spans`` null, from what the batches sent."""

    def spans(docs: np.ndarray, contents: list[bytes]) -> pa.RecordBatch:
        key, nothing = pa.nulls(len(contents), pa.int64()), pa.nulls(len(contents), pa.int32())
        found = pa.array(contents, pa.binary())
        columns = [pa.array(docs, pa.int64()), key, nothing, nothing, nothing, found]
        return pa.record_batch(columns, schema=_FOUND)

    def open_(runs: np.ndarray) -> pa.RecordBatch:
        numbers = [runs["doc"], np.ascontiguousarray(runs["key"]).view(np.int64)]
        numbers += [runs[name].astype(np.int32) for name in ("start", "lead", "size")]
        return pa.record_batch([*map(pa.array, numbers), pa.nulls(len(runs), pa.binary())], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families: dict[int, Family] = {}
        nothing = np.zeros(0, np.uint64)
        for batch in batches:
            kinds, buckets = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            settled = np.flatnonzero(kinds == _SPANS)
            if len(settled):
                part = batch.take(pa.array(settled))
                yield spans(part.column(2).to_numpy(), part.column(3).to_pylist())
            for row in np.flatnonzero(kinds != _SPANS):
                content = batch.column(3)[int(row)].as_py()
                if kinds[row] == _OPEN:
                    yield open_(np.frombuffer(content, _RUN))
                    continue
                family = families.setdefault(int(buckets[row]), Family())
                runs, crowded = np.zeros(0, _RUN), nothing
                if kinds[row] == _CROWD:
                    crowded = np.frombuffer(content, "<u8")
                else:
                    runs = np.frombuffer(content, _RUN)
                gone, left = family.add(runs, crowded)
                if len(gone):
                    yield spans(*_span_rows(gone["doc"], gone["start"], gone["size"]))
                if len(left):
                    yield open_(left)

    schema = "doc_id bigint, key bigint, start int, lead int, size int, spans binary"
    return dealt.repartition("bucket").mapInArrow(run, schema)


def _packed(docs: DataFrame) -> DataFrame:
    """Texts as compressed bytes, for the shuffles that they take."""
    rows = docs.select("doc_id", "id", whole_text().cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, bounds = flat_bytes(batch.column(2))
            cuts = bounds.tolist()
            packed = [pack.compress(data[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            columns = [batch.column(0), batch.column(1), pa.array(packed, pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "id", "packed"])

    return rows.mapInArrow(run, "doc_id bigint, id bigint, packed binary")


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def _string_spans(docs: DataFrame, open_runs: DataFrame, buckets: int) -> DataFrame:
    """Spans of the strings in open runs that also start earlier, ``(doc_id, spans)``.

    Each string of a run is hashed; equal strings have equal keys. The strings of a key
    with very many runs are dealt out by their hash.
    """
    crowds = open_runs.groupBy("key").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") > SHARE)
    shares = written(crowds.select("key", F.ceil(F.col("runs") / SHARE).cast("int").alias("shares")), "shares")
    wanted = open_runs.join(shares, "key", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    run = F.struct("key", "start", "size", "shares")
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(run).alias("runs"))
    texts = _packed(docs).select("doc_id", "packed").join(wanted, "doc_id").select("doc_id", "packed", "runs")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        held: dict[int, tuple[list[bytes], list[np.ndarray]]] = {}
        size = 0

        def put(to: int, key: int, doc: int, start: int, hashes: np.ndarray) -> None:
            heads, all_hashes = held.setdefault(to, ([], []))
            heads.append(struct.pack("<QqiB", key, doc, start, len(hashes)))
            all_hashes.append(hashes)

        def send() -> pa.RecordBatch:
            contents = [
                struct.pack("<I", len(heads)) + b"".join(heads) + np.concatenate(hashes).tobytes()
                for heads, hashes in held.values()
            ]
            to = pa.array(list(held), pa.int32())
            held.clear()
            return pa.record_batch([to, pa.array(contents, pa.binary())], ["bucket", "content"])

        for batch in batches:
            for doc, packed, runs in zip(*(c for c in batch.columns)):
                text, doc = memoryview(_unpack(packed.as_py())), doc.as_py()
                for r in runs.as_py():
                    key, start = r["key"] & (2**64 - 1), r["start"]
                    places = range(start, min(start + r["size"], len(text) - WIDTH + 1))
                    hashes = np.array([digest(text[p : p + WIDTH]) for p in places], np.uint64)
                    size += len(hashes)
                    if r["shares"] == 1 and len(hashes):
                        put(key % buckets, key, doc, start, hashes)
                    elif len(hashes):
                        share = (hashes % np.uint64(r["shares"])).tolist()
                        for k, p in enumerate(places):
                            put((key + share[k]) % buckets, key, doc, p, hashes[k : k + 1])
                if size >= 4 * BATCH_RUNS:
                    yield send()
                    size = 0
        yield send()

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for to, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (n,) = struct.unpack_from("<I", content)
                heads = np.frombuffer(content, _HASHED, n, 4)
                held.setdefault(to, []).append((heads, np.frombuffer(content, "<u8", -1, 4 + heads.nbytes)))
        for parts in held.values():
            heads, hashes = (np.concatenate(c) for c in zip(*parts))
            sizes = heads["size"].astype(np.int64)
            before = np.cumsum(sizes) - sizes
            strings = np.zeros(len(hashes), _RUN)
            strings["key"], strings["doc"] = np.repeat(heads["key"], sizes), np.repeat(heads["doc"], sizes)
            strings["hash"] = hashes
            strings["start"] = np.repeat(heads["start"] - before, sizes) + np.arange(len(hashes))
            strings["size"] = 1
            later = _firsts(_sorted(strings))[1]
            owners, spans = _span_rows(later["doc"], later["start"], later["size"])
            yield pa.record_batch([pa.array(owners, pa.int64()), pa.array(spans, pa.binary())], ["doc_id", "spans"])

    sent = texts.mapInArrow(hashed, "bucket int, content binary")
    return sent.repartition("bucket").mapInArrow(firsts, "doc_id bigint, spans binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, spans)``: bytes covered by an earlier string, as 32-bit pairs; many rows a document.

    ``docs`` is as ``in_order`` gives it. Two families of rows come of one pass over the
    texts: what is settled, and open runs, whose texts are looked up once more.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(_found(_dealt(docs, buckets)), "repeats")
    settled = found.where("spans IS NOT NULL").select("doc_id", "spans")
    open_runs = found.where("spans IS NULL").select("doc_id", "key", "start", "size")
    return settled.unionAll(written(_string_spans(docs, open_runs, buckets), "string-repeats"))


def _merged(parts: list[bytes], size: int) -> np.ndarray:
    """Maximal spans from lists of pairs, within a text of ``size`` bytes."""
    spans = np.frombuffer(b"".join(parts), "<u4").reshape(-1, 2).astype(np.int64)
    spans = np.minimum(spans[np.argsort(spans[:, 0], kind="stable")], size)
    if not len(spans):
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return np.stack([spans[first, 0], reach[np.r_[first[1:], len(spans)] - 1]], axis=1)


def map_repeats(docs: DataFrame, made: str, make) -> DataFrame:
    """``doc_id`` and what ``make(text, spans, kept)`` derives from each text, as bytes.

    One row for each row of ``docs``. ``spans`` are the maximal runs of bytes that are
    covered by a string of ``WIDTH`` bytes which also starts earlier: in a document with a
    smaller ``doc_id``, or before it in the same one; ``kept`` is the text without them.
    A null or empty text, and one shorter than ``WIDTH``, has none. Texts of any length
    count whole. Each row is a document of its own: rows that share a ``doc_id`` come in
    the order of a hash of their texts, rows without one come last in that order, and of
    rows that repeat the first one is the earlier. Other columns are not read.
    """
    docs = in_order(docs)
    spans = repeated_spans(docs).groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))
    texts = _packed(docs).join(spans, "doc_id", "left").select(F.col("id").alias("doc_id"), "packed", "spans")
    schema = arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, out = whole.slice(at, 512), []
                for packed, parts in zip(batch.column(1), batch.column(2)):
                    text = _unpack(packed.as_py())
                    found = _merged(parts.as_py() or [], len(text))
                    cuts = [0, *found.ravel().tolist(), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])) if len(found) else text
                    out.append(make(text, found, kept))
                yield with_id(batch.column(0), out, schema)

    return texts.mapInArrow(run, f"doc_id bigint, {made}")


def digests(text: bytes, spans: np.ndarray, kept: bytes) -> tuple[int, int, int, str]:
    """Bytes, removed bytes, spans and the kept bytes' SHA-256."""
    return len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()
