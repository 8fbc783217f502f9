"""Top-k similarity search of a table of questions over tables of points.

The points are scanned once, where they lie. Each task scores its Arrow batches
against the question matrix with one matrix product per batch and keeps only the
k best points per question and collection, so what leaves a task is bounded by
``questions x collections x k`` however many points it read. One exchange on
``query_id`` merges the partial lists; fusion reuses that partitioning.

The matrix product runs in single precision with a rigorous error bound and only
*selects* candidates; their scores are then recomputed term by term in double
precision, in vector order, so results equal the plain SQL definition and do not
depend on how rows were batched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.vectors import best_first, metric_name
from rankloom.params import check_bound
from rankloom.session import settle

INTERNAL = "internal"
EXTERNAL = "external"
COLLECTIONS = (INTERNAL, EXTERNAL)

# Question matrices up to this size go to every executor; larger question tables
# are split into blocks that meet slices of the points in a grid instead.
BROADCAST_BYTES = 64 << 20
_TILE_CELLS = 4 << 20
# Points of one cell of that grid.
_CELL_BYTES = 1 << 30
# What a question's id, and one of its hits, take in a Python task.
_ID_BYTES, _HIT_BYTES = 64, 80


def search(
    questions: DataFrame,
    points: DataFrame,
    top_k: int = 5,
    metric: str = "cosine",
    score_threshold: float | None = None,
    collections: Iterable[str] = COLLECTIONS,
    broadcast_bytes: int = BROADCAST_BYTES,
    first_look: DataFrame | None = None,
) -> DataFrame:
    """Exact top-k hits ``(query_id, collection, point_id, score, rank)``.

    ``questions``: unique ``query_id``, ``embedding``. ``points``: ``point_id``,
    ``collection``, ``embedding``. Ties go to the smaller ``point_id`` as text.
    ``score_threshold`` is a lower bound, for ``euclid`` an upper one. Null
    vectors, and under ``cosine`` zero vectors, match nothing.

    ``first_look`` may be any small part of ``points``, say one file. It is
    searched first; its k-th best scores are a lower bound on the final ones, so
    the tasks of the full scan send on only what can still win. The result is the
    same with and without it. It is used when the questions fit ``broadcast_bytes``.
    """
    check_bound("top_k", top_k)
    metric = metric_name(metric)
    wanted = list(collections)
    unknown = [c for c in wanted if c not in COLLECTIONS]
    if unknown:
        raise ValueError(f"Invalid collection: {unknown[0]}. Must be one of {COLLECTIONS}")

    vectors = questions.select("query_id", "embedding").dropna()
    known = F.col("point_id").isNotNull() & F.col("embedding").isNotNull()
    corpus = points.where(F.col("collection").isin(wanted) & known).select(
        F.col("point_id").cast("string").alias("point_id"), "collection", "embedding"
    )
    id_type = questions.schema["query_id"].dataType
    options = _Options(top_k, metric, score_threshold)

    asked, dim = _extent(vectors)
    most = _questions_that_fit(dim, top_k, broadcast_bytes)
    if asked > most:
        partial_hits = _joined_blocks(vectors, corpus, id_type, options, asked, dim, most)
    else:
        head = _question_block(vectors)
        bars = {}
        if first_look is not None:
            early = search(
                questions, first_look, top_k, metric, score_threshold, wanted, broadcast_bytes
            )
            bars = _bars(early.where(F.col("rank") == top_k), head[0])
        shared = vectors.sparkSession.sparkContext.broadcast((*head, bars))
        partial_hits = corpus.mapInArrow(
            partial(_score_partition, shared, options), _hit_schema(id_type)
        )
    return rank_hits(partial_hits.repartition("query_id"), top_k, metric)


def rank_hits(scored: DataFrame, top_k: int, metric: str = "cosine") -> DataFrame:
    """Number scored rows from 1 per question and collection and keep ``top_k``."""
    order = Window.partitionBy("query_id", "collection").orderBy(
        best_first(metric_name(metric), F.col("score")), F.col("point_id")
    )
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


# --- planning helpers (driver side) ------------------------------------------


class _Options:
    def __init__(self, top_k: int, metric: str, threshold: float | None) -> None:
        self.top_k, self.metric, self.threshold = top_k, metric, threshold


def _hit_schema(id_type: T.DataType) -> T.StructType:
    # Not nullable: joins then add no null filters, and plans that read the hits
    # twice share one exchange.
    return T.StructType(
        [
            T.StructField("query_id", id_type, False),
            T.StructField("collection", T.StringType(), False),
            T.StructField("point_id", T.StringType(), False),
            T.StructField("score", T.DoubleType(), False),
        ]
    )


def _extent(vectors: DataFrame) -> tuple[int, int]:
    """The number of questions, and the dimension of the widest vector, whatever its row's place.

    They are counted where they lie: a limit would send those that it takes, and up to as many
    of each partition that it drops, through one task.
    """
    asked, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    return asked, dim or 1


def _questions_that_fit(dim: int, top_k: int, budget: int) -> int:
    """How many questions a task can hold: matrix, ids and ``top_k`` hits of each."""
    return max(1, budget // (8 * dim + _ID_BYTES + top_k * _HIT_BYTES))


def _question_block(vectors: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """The ids and the matrix of questions that fit."""
    table = vectors.toArrow()
    if not table.num_rows:
        return pa.array([]), np.zeros((0, 0))
    return table.column("query_id").combine_chunks(), _matrix(table.column("embedding"))


def _bars(last_places: DataFrame, query_ids: pa.Array) -> dict[str, np.ndarray]:
    """Per collection, a score every final hit of a question reaches, or NaN.

    At most one row per question of the shipped block and collection.
    """
    table = last_places.select("query_id", "collection", "score").toArrow()
    bars = {}
    for name in pc.unique(table["collection"]).to_pylist():
        part = table.filter(pc.equal(table["collection"], name))
        at = pc.index_in(query_ids, part["query_id"].combine_chunks())
        bars[name] = pc.take(part["score"], at).to_numpy(zero_copy_only=False)
    return bars


def _joined_blocks(
    vectors: DataFrame,
    corpus: DataFrame,
    id_type: T.DataType,
    options: _Options,
    asked: int,
    dim: int,
    per_lane: int,
) -> DataFrame:
    """Too many questions to ship: a grid of hash blocks of questions and slices of points.

    The points are written down first: they are counted, sent and read again by retries.

    A cell of the grid takes the questions of one ``lane`` and the points of one ``salt``. What
    is sent is the questions once for each salt, with the hits that come back, and the
    points once for each lane; of the grids with cells enough for all cores the one that
    sends least is taken. A lane holds at most ``per_lane`` questions on average, and a
    cell at most ``_CELL_BYTES`` of points; a task reads these batch by batch.
    """
    corpus = settle(corpus)
    spark = vectors.sparkSession
    lanes, salts = _grid(asked, corpus.count(), dim, options.top_k, per_lane, _cells(spark))

    question_blocks = (
        vectors.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(lanes)).alias("lane"))
        .agg(
            F.collect_list("query_id").alias("query_ids"),
            F.collect_list("embedding").alias("query_vectors"),
        )
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    element = corpus.schema["embedding"].dataType.elementType.simpleString()
    block_schema = (
        f"collection string, point_ids array<string>, point_vectors array<array<{element}>>, salt int"
    )
    point_blocks = corpus.mapInArrow(
        partial(_pack_points, options.top_k, salts), block_schema
    ).withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    # A cell's questions come before its points, so a task holds one lane's lists at a time and
    # no question block more than once.
    return (
        question_blocks.unionByName(point_blocks, allowMissingColumns=True)
        .repartition("lane", "salt")
        .sortWithinPartitions("lane", "salt", F.col("query_ids").isNull())
        .select("lane", "salt", "query_ids", "query_vectors", "collection", "point_ids", "point_vectors")
        .mapInArrow(partial(_score_cells, options), _hit_schema(id_type))
    )


def _cells(spark: SparkSession) -> int:
    """So many cells keep all cores busy."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(parts, 4 * spark.sparkContext.defaultParallelism))


def _grid(asked: int, held: int, dim: int, top_k: int, per_lane: int, cells: int) -> tuple[int, int]:
    """The number of lanes and of salts.

    With the cells of a number the bytes sent grow with the input, and not with its square,
    until a lane's or a cell's bound asks for more of them.
    """
    width = max(1, 4 * dim)
    per_question = width + len(COLLECTIONS) * top_k * _HIT_BYTES // 2
    least_lanes = max(1, -(-asked // per_lane))
    least_salts = max(1, -(-held * width // _CELL_BYTES))
    lanes = round((cells * asked * per_question / max(1, held * width)) ** 0.5)
    lanes = max(least_lanes, min(lanes, cells))
    return lanes, max(least_salts, -(-cells // lanes))


# --- task side ---------------------------------------------------------------


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a 2-d array, without a per-row loop."""
    array = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if len(array) == 0:
        return np.zeros((0, 0))
    widths = pc.unique(pc.list_value_length(array)).to_pylist()
    if len(widths) != 1:
        raise ValueError(f"vectors of different dimensions in one collection: {sorted(widths)}")
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), widths[0])


def _drop_surplus_copies(matrix: np.ndarray, top_k: int) -> np.ndarray:
    """Row numbers to keep: of identical vectors only the first ``top_k`` rows.

    Rows come sorted by id and ties go to the smaller id, so later copies can
    never be among the k best. This keeps a vector shared by a large part of the
    corpus from filling the candidate lists.
    """
    n, dim = matrix.shape
    every = np.arange(n)
    if n <= top_k or dim == 0:
        return every
    sample = np.ascontiguousarray(matrix[:, :: max(1, dim // 8)])
    weights = np.random.default_rng(7).integers(1, 2**62, sample.shape[1], dtype=np.uint64)
    digest = (sample.astype(np.float64).view(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    _, first, group, size = np.unique(
        digest, return_index=True, return_inverse=True, return_counts=True
    )
    if size.max() <= top_k:
        return every
    crowded = np.flatnonzero(size[group] > top_k)
    copies = crowded[(matrix[crowded] == matrix[first[group[crowded]]]).all(axis=1)]
    keep = np.ones(n, dtype=bool)
    order = copies[np.argsort(group[copies], kind="stable")]
    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    keep[order[place >= top_k]] = False
    return np.flatnonzero(keep)


def _blocks(batch: pa.RecordBatch, top_k: int) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """Per collection of a batch: ids in ascending order and their vectors."""
    table = pa.Table.from_batches([batch])
    for name in pc.unique(batch.column("collection")).to_pylist():
        part = table.filter(pc.equal(table["collection"], name)).sort_by("point_id")
        matrix = _matrix(part["embedding"])
        keep = _drop_surplus_copies(matrix, top_k)
        ids = part["point_id"].combine_chunks()
        if len(keep) < len(matrix):
            matrix, ids = matrix[keep], ids.take(pa.array(keep))
        yield name, ids, matrix


class _BestHits:
    """The k best points so far of every question row, for one collection."""

    def __init__(
        self, query_matrix: np.ndarray, options: _Options, bar: np.ndarray | None = None
    ) -> None:
        self.options = options
        # Goodness below the bar cannot be among the k best of the whole corpus.
        self.bar = np.full(len(query_matrix), -np.inf)
        if bar is not None:
            signed = -bar if options.metric == "euclid" else bar
            self.bar = np.where(np.isnan(signed), -np.inf, signed)
        self.queries = query_matrix.astype(np.float64)
        with np.errstate(invalid="ignore", over="ignore"):
            self.query_norms = _norms(self.queries) if self.queries.size else np.zeros(len(self.queries))
        usable = np.isfinite(self.query_norms)
        if options.metric == "cosine":
            usable &= self.query_norms > 0
        self.usable = np.flatnonzero(usable)
        n, k = len(query_matrix), options.top_k
        # Goodness: the score, negated for distances, so that larger is better.
        self.goodness = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), "", dtype=object)

    def offer(self, ids: pa.Array, matrix: np.ndarray) -> None:
        if matrix.size == 0:
            return
        options = self.options
        with np.errstate(invalid="ignore", over="ignore"):
            points = matrix.astype(np.float64)
            norms = _norms(points)
        good = np.isfinite(norms)
        if options.metric == "cosine":
            good &= norms > 0
        if not good.all():
            ids, points, norms = ids.filter(pa.array(good)), points[good], norms[good]
        if len(points) == 0 or len(self.usable) == 0:
            return
        if points.shape[1] != self.queries.shape[1]:
            raise ValueError(
                f"question dimension {self.queries.shape[1]}, point dimension {points.shape[1]}"
            )
        names = np.asarray(ids.to_pylist(), dtype=object)
        tile = max(1, _TILE_CELLS // len(points))
        for start in range(0, len(self.usable), tile):
            self._offer_tile(self.usable[start : start + tile], names, points, norms)

    def _offer_tile(
        self, rows: np.ndarray, names: np.ndarray, points: np.ndarray, norms: np.ndarray
    ) -> None:
        options, k = self.options, self.options.top_k
        qn = self.query_norms[rows]
        rough, slack = _rough_goodness(options.metric, self.queries[rows], qn, points, norms)
        least = np.maximum(self.goodness[rows, k - 1], self.bar[rows])
        floor = _on_rough_scale(options.metric, least, qn) - slack
        if len(points) > k and np.isneginf(floor).any():
            kth = np.partition(rough, len(points) - k, axis=1)[:, len(points) - k]
            floor = np.maximum(floor, kth - 2 * slack)
        if options.threshold is not None:
            limit = -options.threshold if options.metric == "euclid" else options.threshold
            floor = np.maximum(floor, _on_rough_scale(options.metric, limit, qn) - slack)
        flat = np.flatnonzero(rough >= floor.astype(rough.dtype)[:, None])
        if len(flat) == 0:
            return
        at, col = np.divmod(flat, len(points))
        exact = _exact_score(
            options.metric, self.queries, points, rows[at], col, self.query_norms, norms
        )
        if options.threshold is not None:
            passed = exact <= options.threshold if options.metric == "euclid" else exact >= options.threshold
            at, col, exact = at[passed], col[passed], exact[passed]
        goodness = -exact if options.metric == "euclid" else exact
        able = goodness >= self.bar[rows[at]]
        self._merge(rows, at[able], goodness[able], names[col[able]])

    def _merge(
        self, rows: np.ndarray, at: np.ndarray, goodness: np.ndarray, names: np.ndarray
    ) -> None:
        k = self.options.top_k
        touched, local = np.unique(at, return_inverse=True)
        if len(touched) == 0:
            return
        target = rows[touched]
        held_row = np.repeat(np.arange(len(target)), k)
        row = np.concatenate([held_row, local])
        value = np.concatenate([self.goodness[target].ravel(), goodness])
        name = np.concatenate([self.ids[target].ravel(), names])
        filled = ~np.isneginf(value)
        row, value, name = row[filled], value[filled], name[filled]
        order = np.lexsort((name.astype("U"), -value, row))
        row, value, name = row[order], value[order], name[order]
        starts = np.searchsorted(row, np.arange(len(target)))
        place = np.arange(len(row)) - starts[row]
        top = place < k
        self.goodness[target] = -np.inf
        self.ids[target] = ""
        self.goodness[target[row[top]], place[top]] = value[top]
        self.ids[target[row[top]], place[top]] = name[top]

    def rows(self, query_ids: pa.Array, collection: str, schema: pa.Schema) -> pa.RecordBatch:
        at, place = np.nonzero(~np.isneginf(self.goodness))
        value = self.goodness[at, place]
        return pa.RecordBatch.from_arrays(
            [
                query_ids.take(pa.array(at)).cast(schema.field("query_id").type),
                pa.array([collection] * len(at), pa.string()),
                pa.array(self.ids[at, place], pa.string()),
                pa.array(-value if self.options.metric == "euclid" else value, pa.float64()),
            ],
            schema=schema,
        )


def _ordered_sums(a: np.ndarray, b: np.ndarray, metric: str = "dot") -> np.ndarray:
    """Row sums of ``a * b`` or ``(a - b) ** 2``, added strictly from left to right."""
    total = np.empty(len(a))
    rows = max(1, (1 << 20) // max(1, a.shape[1]))
    for start in range(0, len(a), rows):
        x, y = a[start : start + rows], b[start : start + rows]
        terms = np.square(x - y) if metric == "euclid" else x * y
        total[start : start + rows] = np.cumsum(terms, axis=1)[:, -1] + 0.0
    return total


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt(_ordered_sums(matrix, matrix))


def _rough_goodness(
    metric: str, q: np.ndarray, qn: np.ndarray, p: np.ndarray, pn: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """A value per pair that orders like the goodness, and a bound on its error.

    For distances that is ``q.p - p.p / 2``, which is ``(q.q - distance^2) / 2``.
    The bounds cover the rounding of inputs, sums and of the later comparison.
    """
    single = max(qn.max(), pn.max()) < 1e15
    kind, unit = (np.float32, 2.0**-24) if single else (np.float64, 2.0**-53)
    terms = q.shape[1] + 12
    if metric == "cosine":
        a, b = q / qn[:, None], p / pn[:, None]
        return a.astype(kind) @ b.astype(kind).T, np.full(len(q), 1.2 * terms * unit)
    rough = q.astype(kind) @ p.astype(kind).T
    largest = pn.max()
    slack = 1.2 * terms * unit * qn * largest + 1e-37
    if metric == "euclid":
        rough -= (pn**2 / 2).astype(kind)
        slack += 4 * unit * (qn**2 + largest**2)
    return rough, slack


def _on_rough_scale(metric: str, goodness, qn: np.ndarray) -> np.ndarray:
    """Exact goodness (for distances the negated distance) as a rough value."""
    if metric == "euclid":
        return (qn**2 - np.square(goodness)) / 2
    return np.broadcast_to(goodness, qn.shape)


def _exact_score(
    metric: str,
    q: np.ndarray,
    p: np.ndarray,
    at: np.ndarray,
    col: np.ndarray,
    qn: np.ndarray,
    pn: np.ndarray,
) -> np.ndarray:
    """Double-precision scores of the candidate pairs, summed in vector order."""
    total = np.empty(len(at))
    rows = max(1, (1 << 22) // max(1, q.shape[1]))
    for start in range(0, len(at), rows):
        part = slice(start, start + rows)
        total[part] = _ordered_sums(q[at[part]], p[col[part]], metric)
    if metric == "euclid":
        return np.sqrt(total)
    return total / (qn[at] * pn[col]) if metric == "cosine" else total


def _arrow_schema(query_ids: pa.Array) -> pa.Schema:
    return pa.schema(
        [
            ("query_id", query_ids.type),
            ("collection", pa.string()),
            ("point_id", pa.string()),
            ("score", pa.float64()),
        ]
    )


def _score_partition(shared, options: _Options, batches: Iterable[pa.RecordBatch]):
    query_ids, query_matrix, bars = shared.value
    best: dict[str, _BestHits] = {}
    for batch in batches:
        if len(query_ids) == 0:
            continue
        for name, ids, matrix in _blocks(batch, options.top_k):
            if name not in best:
                best[name] = _BestHits(query_matrix, options, bars.get(name))
            best[name].offer(ids, matrix)
    for name, hits in best.items():
        yield hits.rows(query_ids, name, _arrow_schema(query_ids))


def _pack_points(top_k: int, salts: int, batches: Iterable[pa.RecordBatch]):
    """A batch's points in ascending order of their ids, cut into a slice for each salt."""
    for batch in batches:
        for name, ids, matrix in _blocks(batch, top_k):
            ids = ids.cast(pa.string())
            # Which salt gets the first slice depends on the content only, so a retry repeats it.
            turn = zlib.crc32(f"{ids[0].as_py()}|{ids[-1].as_py()}".encode()) if len(ids) else 0
            cuts = np.linspace(0, len(ids), salts + 1).astype(int).tolist()
            for k, (start, end) in enumerate(zip(cuts, cuts[1:])):
                if start == end:
                    continue
                rows, dim = end - start, matrix.shape[1]
                vectors = pa.ListArray.from_arrays(
                    pa.array(np.arange(rows + 1, dtype=np.int32) * dim), pa.array(matrix[start:end].ravel())
                )
                whole = pa.array([0, rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name], pa.string()),
                        pa.ListArray.from_arrays(whole, ids.slice(start, rows)),
                        pa.ListArray.from_arrays(whole, vectors),
                        pa.array([(turn + k) % salts], pa.int32()),
                    ],
                    names=["collection", "point_ids", "point_vectors", "salt"],
                )


def _score_cells(options: _Options, batches: Iterable[pa.RecordBatch]):
    """Score the cells of a task, each its question block and then its points."""
    cell, query_ids, queries, best = None, None, None, {}

    def found():
        for name, hits in best.items():
            yield hits.rows(query_ids, name, _arrow_schema(query_ids))

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            here = (row.column("lane")[0].as_py(), row.column("salt")[0].as_py())
            if row.column("query_ids").null_count == 0:
                yield from found()
                cell, best = here, {}
                query_ids = row.column("query_ids").flatten()
                queries = _matrix(row.column("query_vectors").flatten())
                continue
            if here != cell:  # a lane without questions
                continue
            name = row.column("collection")[0].as_py()
            if name not in best:
                best[name] = _BestHits(queries, options)
            best[name].offer(
                row.column("point_ids").flatten(), _matrix(row.column("point_vectors").flatten())
            )
    yield from found()
