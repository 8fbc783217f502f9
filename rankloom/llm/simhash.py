"""SimHash near duplicates through an index in Gray order.

Fingerprints within ``radius`` bits agree in one of ``radius + 1`` blocks of bits. Each
fingerprint goes to one cell for each block, with the block's bits in front. Within a
cell fingerprints are sorted by their Gray rank, which puts those with many equal bits
side by side. Runs of them form leaves, runs of leaves form upper nodes, and a node
holds the bits that all below it share. Two nodes are compared by those bits alone; if
they differ in more than ``radius``, all pairs below them are left out at once.

A cell with many fingerprints is dealt out by a hash into pairs of shares, so that no
task holds more than two shares. Cells yield links to the least member that they
connect, not pairs, so their number is bounded by the members.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import flat_bytes, whole_text, written
from rankloom.llm.components import components, least_of_each

SEED = 42
#: Fingerprints in a share of a cell; a cell of more is dealt out.
SHARE = 16_384
LEAF, FAN = 32, 8
_STEP = 65_536


def _shingles(text: bytes, words_each: int) -> list[bytes]:
    words = text.lower().split()
    if len(words) <= words_each:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [line[a : b - 1] for a, b in zip(starts, ends[words_each - 1 :])]


def fingerprint(text: bytes, words_each: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words give 0."""
    shingles = _shingles(text, words_each)
    parts = (shingles[at : at + _STEP] for at in range(0, len(shingles), _STEP))
    return print_of(np.array([xxhash.xxh64_intdigest(s, SEED) for s in part], "<u8") for part in parts)


def print_of(parts: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes that come in parts, as a signed number."""
    ones, many = np.zeros(64, np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
        many += len(hashes)
    set_bits = np.packbits(2 * ones > many, bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words_each: int = 3, keyed: bool = False) -> DataFrame:
    """Rows ``(doc_id, print)``, the print as a signed 64-bit number; ``keyed``, with ``text_key`` too."""
    key = [F.xxhash64(whole_text()).alias("text_key")] if keyed else []
    names = ["doc_id", "print", *["text_key"] * keyed]
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text"), *key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat_bytes(batch.column(1))
            cuts = bounds.tolist()
            prints = [fingerprint(data[a:b].tobytes(), words_each) for a, b in zip(cuts, cuts[1:])]
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.int64()), *batch.columns[2:]], names)

    return rows.mapInArrow(run, ", ".join(f"{name} bigint" for name in names))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _rotated(codes: np.ndarray, by: np.ndarray) -> np.ndarray:
    left = by.astype(np.uint64) & np.uint64(63)
    return (codes << left) | (codes >> ((np.uint64(64) - left) & np.uint64(63)))


class _Groups:
    """Which rows are connected; a row's parent is a row of smaller or equal index."""

    def __init__(self, size: int) -> None:
        self.of = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            left, right = self.of[a], self.of[b]
            apart = left != right
            if not apart.any():
                return
            a, b, left, right = a[apart], b[apart], left[apart], right[apart]
            np.minimum.at(self.of, np.maximum(left, right), np.minimum(left, right))
            while True:
                higher = self.of[self.of]
                if np.array_equal(higher, self.of):
                    break
                self.of = higher


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From leaves up: first row or child of each node, mask of shared bits, their values."""
    starts = np.arange(0, len(codes), LEAF)
    every, some = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
    levels = [(starts, every | ~some, every)]
    while len(levels[-1][0]) > FAN:
        starts = np.arange(0, len(every), FAN)
        every, some = np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(some, starts)
        levels.append((starts, every | ~some, every))
    return levels


def _spread(a: np.ndarray, b: np.ndarray, fan: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of ``a[i]`` and one of ``b[i]``, each unordered pair once."""
    left = (a[:, None, None] * fan + np.arange(fan)[None, :, None]).repeat(fan, axis=2).ravel()
    right = (b[:, None, None] * fan + np.arange(fan)[None, None, :]).repeat(fan, axis=1).ravel()
    good = (left < size) & (right < size) & (left <= right)
    return left[good], right[good]


def _cell_links(codes: np.ndarray, groups: _Groups, place: np.ndarray, radius: int) -> None:
    """Join in ``groups`` what one cell connects; ``codes`` are in Gray order."""
    levels = _levels(codes)
    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    a, b = np.meshgrid(roots, roots, indexing="ij")
    work = [(top, a[a <= b], b[a <= b])]
    most = {True: 256, False: 4096}
    while work:
        level, a, b = work.pop()
        if len(a) > (step := most[level == 0]):
            work.append((level, a[step:], b[step:]))
            a, b = a[:step], b[:step]
        _, mask, value = levels[level]
        near = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b]) <= radius
        a, b = a[near], b[near]
        if level:
            work.append((level - 1, *_spread(a, b, FAN, len(levels[level - 1][0]))))
            continue
        # Leaves that are one group already, with each other too, have nothing to add.
        of, starts = groups.of[place], levels[0][0]
        low, high = np.minimum.reduceat(of, starts), np.maximum.reduceat(of, starts)
        open_ = np.minimum(low[a], low[b]) != np.maximum(high[a], high[b])
        i, j = _spread(a[open_], b[open_], LEAF, len(codes))
        linked = (i < j) & (np.bitwise_count(codes[i] ^ codes[j]) <= radius)
        groups.join(place[i[linked]], place[j[linked]])


def _links_of(cells: np.ndarray, codes: np.ndarray, ids: np.ndarray, radius: int) -> tuple:
    """Links ``(id, least id connected with it)`` of whole cells; rows lie in cell order."""
    order = np.argsort(ids, kind="stable")  # so that the least row is the least id
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sizes = np.diff(np.r_[starts, len(cells)])
    small = np.repeat(sizes <= LEAF, sizes)
    groups = _Groups(len(ids))
    # A cell that is one leaf: rows at a distance of 1, 2, ... in one sweep over all cells.
    for apart in range(1, min(LEAF, len(cells))):
        i = np.flatnonzero(small[:-apart] & (cells[apart:] == cells[:-apart]))
        if not len(i):
            break
        i = i[np.bitwise_count(codes[i] ^ codes[i + apart]) <= radius]
        groups.join(place[i], place[i + apart])
    for k in np.flatnonzero(sizes > LEAF):
        rows = slice(starts[k], starts[k] + sizes[k])
        _cell_links(codes[rows], groups, place[rows], radius)
    by_id = ids[order]
    moved = np.flatnonzero(groups.of != np.arange(len(ids)))
    return by_id[moved], by_id[groups.of[moved]]


def near_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``(a, b)`` that connect all ``(id, print)`` within ``radius`` bits of each other.

    ``prints`` has each print once. Not every pair is a row, but what pairs connect is
    connected by the rows, and rows connect nothing else.
    """
    widths = [64 // (radius + 1) + (k < 64 % (radius + 1)) for k in range(radius + 1)]
    offsets = [0, *accumulate(widths)][:-1]
    blocks = F.array(*[
        F.struct(
            F.lit(k).alias("block"),
            F.expr(f"shiftrightunsigned(shiftleft(print, {at}), {64 - width})").alias("front"),
        )
        for k, (at, width) in enumerate(zip(offsets, widths))
    ])
    spread = prints.select("id", "print", F.explode(blocks).alias("at")).select("id", "print", "at.*")
    full = written(
        spread.groupBy("block", "front").agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > SHARE)
        .select("block", "front", F.ceil(F.col("rows") / SHARE).cast("int").alias("shares")),
        "full-cells",
    )
    dealt = spread.join(full, ["block", "front"], "left")
    shares = F.coalesce("shares", F.lit(1))
    share = F.pmod(F.xxhash64("print"), shares).cast("int")
    cells = dealt.select("block", "front", "id", "print", share.alias("own"), shares.alias("shares")).select(
        "block", "front", "id", "print", "own",
        F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("other"),
    )
    cells = cells.select(
        F.xxhash64("block", "front", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        F.expr(f"element_at(array({','.join(map(str, offsets))}), block + 1)").alias("turn"),
        "id",
        "print",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            cell, turn, ids, codes = (np.concatenate(x) for x in zip(*parts))
            codes = codes.view(np.uint64)
            order = np.lexsort((gray_rank(_rotated(codes, turn)), cell))
            a, b = _links_of(cell[order], codes[order], ids[order], radius)
            return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            # Cells come one after another; the last of the batch may go on.
            cell = columns[0]
            cut = int(np.searchsorted(cell, cell[-1]))
            if cut == 0 and held and held[-1][0][-1] == cell[0]:
                held.append(columns)
                rows += len(cell)
                continue
            held.append([c[:cut] for c in columns])
            if rows + cut:
                yield links(held)
            held, rows = [[c[cut:] for c in columns]], len(cell) - cut
        if rows:
            yield links(held)

    dealt_out = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt_out.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words_each: int = 3, radius: int = 3) -> DataFrame:
    """Rows ``(doc_id, fingerprint, component_id)``, one for each row of ``docs``.

    ``fingerprint`` is 16 hex digits. Documents link when their fingerprints differ in
    ``radius`` bits or fewer; ``component_id`` is the smallest ``doc_id`` reachable. A
    text with fewer words than a shingle is one shingle; null, empty and blank texts
    have the print of zeros and link like any other. Rows that repeat get equal rows. A
    row without ``doc_id`` gets the component of its print, null if nobody else has it,
    and links nothing. Other columns are not read.
    """
    prints = written(fingerprints(docs, words_each), "prints")
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("id")).where("id IS NOT NULL")
    nodes = written(nodes, "print-nodes")
    found = components(near_links(nodes, radius))
    labels = nodes.join(found, nodes["id"] == found["node"], "left").select(
        "print", F.coalesce("component", "id").alias("component_id")
    )
    labels = written(labels, "print-components")
    return prints.join(labels, "print", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, words_each: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` that are first in their component, with all their columns.

    Prints are what links connect, so an id's texts and rows without ``doc_id`` are judged each on
    their own. The smallest ``doc_id`` stays, null last; rows that repeat id and text count as one.
    """
    prints = written(fingerprints(docs, words_each, keyed=True), "prints")
    nodes = written(prints.select(F.col("print").alias("id"), "print").distinct(), "print-nodes")
    found = written(components(near_links(nodes, radius)), "print-components")
    labels = prints.join(found, prints["print"] == found["node"], "left").select(
        "doc_id", "text_key", F.coalesce("component", "print").alias("component")
    )
    return least_of_each(docs, labels)
