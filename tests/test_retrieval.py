import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.operators.idfilter import SLOTS, passing, wanted_bits
from rankloom.operators import context as ctx
from rankloom.operators import fusion as fu
from rankloom.operators import similarity as sim

POINTS = "point_id string, collection string, embedding array<float>"


def brute_force(questions, points, k, metric, threshold=None):
    out = {}
    for qid, q in questions:
        for name in sim.COLLECTIONS:
            scored = []
            for pid, coll, p in points:
                if coll != name or p is None:
                    continue
                dot = qq = pp = dist = 0.0
                for a, b in zip(q, p):
                    dot += a * b
                    qq += a * a
                    pp += b * b
                    dist += (a - b) * (a - b)
                if metric == "cosine" and (qq == 0 or pp == 0):
                    continue
                score = {"dot": dot, "euclid": math.sqrt(dist)}.get(metric)
                if score is None:
                    score = dot / (math.sqrt(qq) * math.sqrt(pp))
                if threshold is not None and (score > threshold if metric == "euclid" else score < threshold):
                    continue
                scored.append((score if metric == "euclid" else -score, pid, score))
            for rank, (_, pid, score) in enumerate(sorted(scored)[:k], 1):
                out[qid, name, rank] = (pid, score)
    return out


def random_corpus(seed, n=400, dim=6):
    """Small integer vectors, so that ties are frequent; a third are one copy."""
    rng = random.Random(seed)
    hot = [1.0, 2.0, 0.0, 1.0, 0.0, 3.0]
    points = []
    for i in range(n):
        v = hot if rng.random() < 1 / 3 else [float(rng.randint(-2, 3)) for _ in range(dim)]
        points.append((str(i), rng.choice(sim.COLLECTIONS), v))
    points += [("zero", "internal", [0.0] * dim), ("null", "external", None)]
    questions = [(i, [float(rng.randint(-2, 3)) for _ in range(dim)]) for i in range(40)]
    questions += [(98, hot), (99, [0.0] * dim)]
    return questions, points


@pytest.mark.parametrize("metric", ["dot", "cosine", "euclid"])
@pytest.mark.parametrize("budget", [sim.BROADCAST_BYTES, 8 * 6 * 7])
def test_search_equals_brute_force(spark, monkeypatch, metric, budget):
    monkeypatch.setattr(sim, "_CELL_BYTES", 4 * 6 * 60)  # several cells per question block
    questions, points = random_corpus(3)
    q = spark.createDataFrame(questions, "query_id long, embedding array<float>")
    p = spark.createDataFrame(points, POINTS).repartition(5)
    found = sim.search(q, p, 7, metric, broadcast_bytes=budget).collect()
    got = {(r.query_id, r.collection, r["rank"]): (r.point_id, r.score) for r in found}
    want = brute_force(questions, points, 7, metric)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == want[k][1] for k in want)


@pytest.mark.parametrize("metric,threshold", [("dot", 9.0), ("cosine", 0.8), ("euclid", 3.0)])
def test_search_threshold(spark, metric, threshold):
    questions, points = random_corpus(4, 150)
    q = spark.createDataFrame(questions, "query_id long, embedding array<float>")
    p = spark.createDataFrame(points, POINTS)
    found = sim.search(q, p, 5, metric, threshold).collect()
    got = {(r.query_id, r.collection, r["rank"]): r.point_id for r in found}
    want = brute_force(questions, points, 5, metric, threshold)
    assert got == {k: v[0] for k, v in want.items()}


def test_search_double_vectors_and_text_ids(spark):
    questions = [("a", [0.1, 0.2]), ("b", [0.3, -0.1])]
    points = [(str(i), "internal", [math.sin(i), math.cos(i)]) for i in range(50)]
    q = spark.createDataFrame(questions, "query_id string, embedding array<double>")
    p = spark.createDataFrame(points, "point_id string, collection string, embedding array<double>")
    for budget in (sim.BROADCAST_BYTES, 16):
        got = {
            (r.query_id, r["rank"]): (r.point_id, r.score)
            for r in sim.search(q, p, 3, "cosine", broadcast_bytes=budget).collect()
        }
        want = brute_force(questions, points, 3, "cosine")
        assert got == {(k[0], k[2]): v for k, v in want.items()}


def test_search_arguments(spark):
    q = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    p = spark.createDataFrame([("1", "internal", [1.0])], POINTS)
    for bad in (-1, 101):
        with pytest.raises(ValueError, match="top_k must be between"):
            sim.search(q, p, bad)
    with pytest.raises(ValueError, match="Invalid collection"):
        sim.search(q, p, collections=["other"])
    wide = spark.createDataFrame([("1", "internal", [1.0, 2.0])], POINTS)
    with pytest.raises(Exception, match="dimension"):
        sim.search(q, wide).collect()
    none = q.where("false")
    assert sim.search(none, p).count() == 0
    assert sim.search(q, p.where("false")).count() == 0


@pytest.mark.parametrize("metric", ["dot", "cosine", "euclid"])
def test_first_look_changes_nothing(spark, metric):
    questions, points = random_corpus(5)
    q = spark.createDataFrame(questions, "query_id long, embedding array<float>")
    p = spark.createDataFrame(points, POINTS).repartition(5)
    plain = sim.search(q, p, 6, metric).collect()
    part = p.where(F.col("point_id").try_cast("int") < 60)
    primed = sim.search(q, p, 6, metric, first_look=part).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, primed))


def test_search_plan_has_one_exchange(spark):
    q = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    p = spark.createDataFrame([("1", "internal", [1.0])], POINTS)
    fused = fu.reciprocal_rank_fusion(sim.search(q, p))
    plan = fused._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_surplus_copies_keep_the_smallest_ids():
    matrix = np.array([[1, 2]] * 6 + [[3, 4]] + [[1, 2]] * 2, dtype=np.float32)
    assert sim._drop_surplus_copies(matrix, 2).tolist() == [0, 1, 6]
    assert sim._drop_surplus_copies(matrix, 20).tolist() == list(range(9))


# --- fusion -------------------------------------------------------------------


def reference_fusion(internal, external, k=60):
    """Plain statement of the rule: add 1/(k+rank), stable sort by score."""
    total, where = {}, {}
    for name, ids in (("internal", internal), ("external", external)):
        for rank, pid in enumerate(ids, 1):
            pid = str(pid)
            total[pid] = total.get(pid, 0.0) + 1.0 / (k + rank)
            where.setdefault(pid, set()).add(name)
    ordered = sorted(total, key=lambda p: -total[p])
    return [(p, total[p], "both" if len(where[p]) == 2 else next(iter(where[p]))) for p in ordered]


def fuse(spark, lists):
    rows = [
        (qid, name, str(pid), rank)
        for qid, (internal, external) in enumerate(lists)
        for name, ids in (("internal", internal), ("external", external))
        for rank, pid in enumerate(ids, 1)
    ]
    hits = spark.createDataFrame(rows, "query_id int, collection string, point_id string, rank int")
    fused = fu.reciprocal_rank_fusion(hits).orderBy("query_id", "fused_rank").collect()
    out = [[] for _ in lists]
    for r in fused:
        out[r.query_id].append((r.point_id, r.fused_score, r.source))
    return out


def test_fusion_cases(spark):
    lists = [
        ([1, 2], [2, 3]),      # shared id first
        ([], [5, 6]),
        ([7], []),
        ([1], ["1"]),          # ids compare as text
        ([1, 2, 3], [4, 5, 6]),  # ties: internal first
        ([1, 1, 2], [3]),      # duplicate inside one list adds up
    ]
    assert fuse(spark, lists) == [reference_fusion(a, b) for a, b in lists]


def test_fusion_random(spark):
    rng = random.Random(11)
    lists = []
    for _ in range(300):
        ids = list(range(14))
        lists.append((rng.sample(ids, rng.randint(0, 9)), rng.sample(ids, rng.randint(0, 9))))
    assert fuse(spark, lists) == [reference_fusion(a, b) for a, b in lists]


def test_hit_counts_are_list_lengths(spark):
    rows = [(1, "internal", "a", 1), (1, "internal", "a", 2), (1, "external", "a", 1)]
    hits = spark.createDataFrame(rows, "query_id int, collection string, point_id string, rank int")
    assert tuple(fu.hit_counts(hits).first()) == (1, 2, 1, 1)


# --- context --------------------------------------------------------------------


def test_payload_defaults_and_internal_preference(spark):
    rows = [(1, "internal", "a", 1), (1, "external", "a", 1), (1, "external", "b", 2), (1, "internal", "c", 2)]
    hits = spark.createDataFrame(rows, "query_id int, collection string, point_id string, rank int")
    payload = spark.createDataFrame(
        [("a", "internal", "inside", {"u": "1"}), ("a", "external", "outside", None), ("b", "external", None, None)],
        "point_id string, collection string, text string, metadata map<string,string>",
    )
    out = ctx.attach_payload(fu.reciprocal_rank_fusion(hits), payload, 5)
    got = {r.point_id: (r.text, r.metadata) for r in out.collect()}
    assert got == {"a": ("inside", {"u": "1"}), "b": ("", {}), "c": ("", {})}
    top = ctx.attach_payload(fu.reciprocal_rank_fusion(hits), payload, 2).collect()
    assert sorted(r.point_id for r in top) == ["a", "c"]


def test_id_filter_passes_what_is_wanted(spark):
    """All wanted ids pass and hardly any other; the filter's size is bounded."""
    every = spark.range(200_000).select(F.col("id").cast("string").alias("point_id"), F.lit("c").alias("collection"), F.lit("x").alias("text"))
    keys = ["point_id", "collection"]
    wanted = every.where("CAST(point_id AS INT) % 1000 < 5")
    bits = wanted_bits(wanted, keys)
    out = passing(every, keys, bits)
    assert out.columns == every.columns
    found = {r.point_id for r in out.collect()}
    assert found >= {str(k) for k in range(200_000) if k % 1000 < 5} and len(found) < 1050
    assert bits.count() <= SLOTS // 32_768 and bits.select(F.max(F.octet_length("_bits"))).first()[0] == 4096
    assert passing(every, keys, wanted_bits(wanted.limit(0), keys)).count() == 0
    whole = spark.range(300_000).select(F.col("id").alias("k"))
    assert passing(whole, ["k"], wanted_bits(whole, ["k"])).count() == 300_000


def test_markdown_and_report(spark, tmp_path):
    answer = F.struct(
        F.lit("q").alias("question"), F.lit("a").alias("answer"),
        F.array(F.struct(F.lit("t").alias("text"), F.lit("both").alias("source"), F.lit(0.5).alias("score"))).alias("sources"),
        F.struct(*[F.lit(None).alias(c) for c in ("model", "tokens_used", "internal_hits", "external_hits", "fused_results")]).alias("metadata"),
    )
    rows = spark.range(1).select(answer.alias("answer"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("ts"))
    ctx.write_markdown(rows, str(tmp_path / "md"))
    text = "\n".join(p.read_text() for p in (tmp_path / "md").glob("part-*"))
    assert text.strip() == "# RAG — 20240102_030405\n\n**Soru:** q\n\na\n\n## Kaynaklar\n- [Kaynak 1] (both): t"
    report = rows.select(ctx.text_report(F.col("answer")).alias("r")).first()["r"]
    assert "[Kaynak 1] (both) - Score: 0.5\n  t\n" in report
    assert "Model: N/A\nTokens: 0\n" in report


def test_requests_and_responses(spark):
    bodies = spark.createDataFrame([('{"q": "test"}',), ("{}",), ("not json",)], "body string")
    assert [r[0] for r in bodies.select(ctx.parse_request(F.col("body"))).collect()] == ["test", None, None]
    answer = F.struct(F.lit("q").alias("question"), F.array(F.lit("s")).alias("sources"))
    got = spark.range(1).select(ctx.json_response(answer)).first()[0]
    assert got == '{"question":"q","sources":["s"]}'


@pytest.mark.parametrize("partitions", ["100", "600"])
def test_what_the_grid_sends_grows_with_the_input(spark, partitions):
    """Six times the rows are sent as six times the rows, however many partitions there are."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        cells = sim._cells(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

    def sent(rows):
        lanes, salts = sim._grid(rows, rows, 64, 5, 70_000, cells)
        assert lanes * salts >= cells and rows / lanes <= 70_000
        return rows * (lanes + salts)

    assert sent(600_000) <= 8 * sent(100_000)
    assert sent(600_000) <= 20 * 600_000


def test_points_of_a_lane_without_questions():
    def row(lane, questions=None, points=None):
        return {
            "lane": lane, "salt": 0, "query_ids": questions and [k for k, _ in questions],
            "query_vectors": questions and [v for _, v in questions], "collection": points and "internal",
            "point_ids": points and [k for k, _ in points], "point_vectors": points and [v for _, v in points],
        }

    rows = [row(0, questions=[(7, [1.0])]), row(0, points=[("a", [2.0])]), row(1, points=[("b", [3.0])])]
    rows += [row(2, questions=[(8, [1.0])]), row(2, points=[("c", [4.0]), ("d", [5.0])])]
    out = list(sim._score_cells(sim._Options(1, "dot", None), [pa.RecordBatch.from_pylist(rows)]))
    assert [r for batch in out for r in zip(*batch.to_pydict().values())] == [
        (7, "internal", "a", 2.0), (8, "internal", "d", 5.0)
    ]


def test_questions_are_counted_where_they_lie(spark, monkeypatch):
    """No task and no driver gets a part of the questions to find out that there are too many."""
    questions, points = random_corpus(6, 60)
    q = spark.createDataFrame(questions, "query_id long, embedding array<float>")
    p = spark.createDataFrame(points, POINTS)

    def unless_vectors(method):
        def call(rows, *given):
            assert "embedding" not in rows.columns, "questions were fetched"
            return method(rows, *given)

        return call

    frame = type(q)
    monkeypatch.setattr(frame, "limit", unless_vectors(frame.limit))
    shipped = sim.search(q, p, 3, "dot").collect()
    monkeypatch.setattr(frame, "toArrow", unless_vectors(frame.toArrow))
    assert sorted(sim.search(q, p, 3, "dot", broadcast_bytes=8 * 6 * 7).collect()) == sorted(shipped)
