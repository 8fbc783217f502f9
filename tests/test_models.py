import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.operators import answers as ans
from rankloom.operators import models as md
from rankloom.params import Params
from rankloom.plans.standins import LetterCountEmbedder
from rankloom.sources import reqlog


# The model classes below travel to the workers with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Counting:
    """Embedder that writes one line per call, readable from the driver."""

    def __init__(self, path, fail=0, error=md.ModelError, short=0):
        self.path, self.fail, self.error, self.short = str(path), fail, error, short

    def embed(self, texts):
        with open(self.path, "a") as f:
            f.write(f"{len(texts)}\n")
        calls = len(open(self.path).readlines())
        if calls <= self.fail:
            raise self.error("API error")
        return [[float(len(t)), 1.0] for t in texts][: len(texts) - self.short] + [[0.0, 0.0]] * 0

    def calls(self):
        return [int(x) for x in open(self.path).read().split()]


class Scripted:
    model = "scripted"

    def __init__(self, error=None):
        self.error = error

    def generate(self, system, user, temperature, max_tokens):
        assert (temperature, max_tokens) == (0.3, 800)
        if self.error:
            raise self.error
        return "cevap", 12


def test_single_embed(spark, tmp_path):
    e = Counting(tmp_path / "c")
    assert md.embed("  Test text ", e) == [9.0, 1.0]
    assert md.embed("a" * 10000, e)[0] == 8000.0
    for blank in ("", "   "):
        with pytest.raises(ValueError, match="Cannot embed empty text"):
            md.embed(blank, e)


def test_embed_failure_is_wrapped(tmp_path, monkeypatch):
    monkeypatch.setattr(md.with_retries, "__kwdefaults__", {"attempts": 3, "base": 0.0, "sleep": lambda s: None})
    with pytest.raises(md.EmbeddingError, match="Failed to generate embedding"):
        md.embed("x", Counting(tmp_path / "a", fail=9))
    assert md.embed("x", Counting(tmp_path / "b", fail=2)) == [1.0, 1.0]


def test_retry_waits():
    waits, tries = [], []

    def call():
        tries.append(1)
        raise md.ModelError("no")

    with pytest.raises(md.ModelError):
        md.with_retries(call, sleep=waits.append)
    assert len(tries) == 3 and waits == [0.2, 0.4]


def test_list_embed(spark, tmp_path):
    e = Counting(tmp_path / "c")
    assert len(md.embed_batch(["text1", "", "text2", "   "], e)) == 2
    assert len(md.embed_batch([f"text{i}" for i in range(25)], e, 10)) == 25
    assert e.calls() == [2, 10, 10, 5]
    with pytest.raises(ValueError, match="Cannot embed empty list"):
        md.embed_batch([], e)
    with pytest.raises(ValueError, match="All texts are empty"):
        md.embed_batch([" "], e)
    for size in (0, 3000):
        with pytest.raises(ValueError, match="batch_size must be between"):
            md.embed_batch(["text"], e, size)


def test_table_embed_batches_distinct_texts(spark, tmp_path):
    e = Counting(tmp_path / "c")
    rows = [(i, f"text{i:02d}") for i in range(25)] + [(100 + i, "text00 ") for i in range(30)] + [(200, "  "), (201, None)]
    data = spark.createDataFrame(rows, "id long, t string")
    out = md.embed_texts(data, "t", e, batch_size=10, parallel_calls=1).cache()
    got = {r.id: r.embedding for r in out.collect()}
    assert len(got) == 57 and got[200] is None and got[201] is None
    assert got[0] == got[100] == [6.0, 1.0]
    assert e.calls() == [10, 10, 5]
    out.unpersist()
    with pytest.raises(ValueError, match="batch_size must be between"):
        md.embed_texts(data, "t", e, batch_size=0)


def test_table_embed_marks_failures(spark, tmp_path):
    data = spark.createDataFrame([(1, "a")], "id long, t string")
    for error, kind in ((md.ModelError, "embedding"), (ConnectionError, "database"), (KeyError, "unexpected")):
        out = md.embed_texts(data, "t", Counting(tmp_path / kind, 99, error), parallel_calls=1).first()
        assert out.embedding is None and out.embed_error_type == kind and "API error" in out.embed_error
    out = md.embed_texts(data, "t", Counting(tmp_path / "short", short=1)).first()
    assert out.embed_error == "no vector returned"


def test_provider_choice():
    providers = {"openai": "remote"}
    assert md.select_embedder("openai", providers) == "remote"
    assert md.select_embedder("bge-m3", providers) == "remote"
    with pytest.raises(ValueError, match="Unknown embed_provider"):
        md.select_embedder("other", providers)


QUESTIONS = [(1, "bir soru"), (2, " bir soru\n"), (3, "iki"), (4, "   ")]


def run(spark, embedder=None, generator=None, points=True, cache=None, **options):
    questions = spark.createDataFrame(QUESTIONS, "query_id long, q string")
    data = [("p1", "internal", [3.0, 1.0]), ("p1", "external", [3.0, 1.0]), ("p2", "external", [9.0, 1.0])]
    corpus = spark.createDataFrame(data, "point_id string, collection string, embedding array<double>")
    payload = spark.createDataFrame([("p1", "x" * 600), ("p2", "kısa")], "point_id string, text string")
    return ans.answer_questions(
        questions, corpus if points else corpus.where("false"), payload,
        embedder or LetterCountEmbedder(), generator or Scripted(),
        now=F.lit("2024-01-01 00:10:00").cast("timestamp"), cache=cache, **options,
    )


class Length:
    def embed(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_answer_job(spark):
    job = run(spark, Length())
    got = {r.query_id: r for r in job.answers.collect()}
    assert [got[i].cache_event for i in (1, 2, 3, 4)] == ["miss", "miss", "miss", "blank"]
    a = got[1].answer
    assert a.answer == "cevap\n\n" + tx.DISCLAIMER and a.error is None
    assert got[2].answer == a
    assert (a.metadata.internal_hits, a.metadata.external_hits, a.metadata.fused_results) == (1, 2, 2)
    assert a.metadata.tokens_used == 12 and a.metadata.model == "scripted"
    assert a.sources[0].source == "both" and a.sources[0].text == "x" * 200 + "..."
    assert a.sources[0].score == pytest.approx(0.0325, abs=1e-4)
    assert got[4].answer.error == tx.EMPTY_QUESTION_ERROR
    assert got[4].answer.metadata.error == "Empty question" and got[4].answer.sources == []
    assert job.cache_entries.count() == 2
    stages = {(r.stage, r.tokens) for r in job.stage_events.collect()}
    assert stages == {("embed", None), ("search", None), ("generate", 12), ("total", None)}
    searched = [(r.collection, r.seconds >= 0) for r in job.stage_events.where("stage = 'search'").collect()]
    assert sorted(searched) == [("external", True)] * 2 + [("internal", True)] * 2
    for r in job.stage_events.groupBy("stage").agg(F.sum("seconds").alias("s")).collect():
        assert r.s >= 0


def test_cache_round_trip(spark, tmp_path):
    path = str(tmp_path / "cache")
    first = run(spark, Length())
    ans.append_cache(first.cache_entries, path)
    again = run(spark, Length(), Scripted(RuntimeError("must not be called")), cache=spark.read.parquet(path))
    events = {r.query_id: (r.cache_event, r.answer.answer) for r in again.answers.collect()}
    assert events[1] == ("hit", "cevap\n\n" + tx.DISCLAIMER) and events[3][0] == "hit"
    assert again.cache_entries.count() == 0
    old = spark.read.parquet(path).withColumn("set_ts", F.col("set_ts") - F.expr("interval 301 seconds"))
    assert {r.cache_event for r in run(spark, Length(), cache=old).answers.collect()} == {"expired", "blank"}
    edge = spark.read.parquet(path).withColumn("set_ts", F.col("set_ts") - F.expr("interval 300 seconds"))
    assert {r.cache_event for r in run(spark, Length(), cache=edge).answers.collect()} == {"hit", "blank"}
    off = run(spark, Length(), cache=edge, params=Params(enable_cache=False))
    assert {r.cache_event for r in off.answers.collect()} == {"miss", "blank"}


def test_single_question_calls(spark, tmp_path):
    corpus = spark.createDataFrame(
        [("p", "internal", [3.0, 1.0])], "point_id string, collection string, embedding array<double>"
    )
    payload = spark.createDataFrame([("p", "metin")], "point_id string, text string")
    out = ans.retrieve_answer(spark, " bir soru ", corpus, payload, Length(), Scripted())
    assert out["question"] == "bir soru" and out["sources"][0]["text"] == "metin"
    out = ans.generate_answer(spark, "q", [{"text": "a"}, {}], Scripted())
    assert out["answer"].startswith("cevap") and out["tokens_used"] == 12
    out = ans.generate_answer(spark, "q", [], Scripted(RuntimeError("no call")))
    assert out["answer"].startswith(tx.NO_CONTEXT_REPLY) and out["tokens_used"] == 0
    path = str(tmp_path / "flush")
    ans.append_cache(run(spark, Length()).cache_entries, path)
    assert ans.flush_cache(spark, path) == 2 and spark.read.parquet(path).count() == 0


def test_no_hits_is_not_cached(spark):
    job = run(spark, Length(), points=False)
    a = {r.query_id: r.answer for r in job.answers.collect()}[1]
    assert a.answer.startswith(tx.NO_HITS_REPLY) and a.sources == [] and a.error is None
    assert a.metadata.fused_results == 0 and a.metadata.tokens_used == 0
    assert job.cache_entries.count() == 0


def test_model_failure_is_cached_with_error(spark, monkeypatch):
    job = run(spark, Length(), Scripted(md.ModelError("down")))
    a = {r.query_id: r.answer for r in job.answers.collect()}[1]
    assert a.answer.startswith(tx.MODEL_FAILURE_REPLY) and a.error == "OpenAI error: down"
    assert a.metadata.tokens_used == 0 and a.sources
    assert job.cache_entries.count() == 2


@pytest.mark.parametrize(
    "error,kind,message",
    [
        (ConnectionError("x"), "database", "Database error: x"),
        (md.AnswerError("x"), "rag", "x"),
        (RuntimeError("x"), "unexpected", "Unexpected error: x"),
    ],
)
def test_stage_failures(spark, error, kind, message):
    job = run(spark, Length(), Scripted(error))
    a = {r.query_id: r.answer for r in job.answers.collect()}[1]
    assert a.metadata.error_type == kind and a.error == message
    assert a.answer.startswith(tx.STAGE_FAILURE_REPLIES[kind]) and a.sources == []
    assert job.cache_entries.count() == 0


def test_embedding_failure(spark, tmp_path):
    job = run(spark, Counting(tmp_path / "c", 99))
    a = {r.query_id: r.answer for r in job.answers.collect()}[1]
    assert a.metadata.error_type == "embedding" and a.error.startswith("Embedding error: ")


def test_no_context_reply_makes_no_call(spark):
    rows = spark.createDataFrame([(1, None, None)], "id long, system_prompt string, user_prompt string")
    out = md.generate_answers(rows, Scripted(RuntimeError("no call"))).first()
    assert out.answer == tx.NO_CONTEXT_REPLY + "\n\n" + tx.DISCLAIMER and out.tokens_used == 0


def test_stage_events_table(spark, tmp_path):
    rows = spark.createDataFrame([(0.5, None, "ok", 3)], "e double, g double, status string, tokens long")
    out = reqlog.stage_events(rows, F.lit("2024-01-01").cast("timestamp"), F.lit("m"), {"embed": F.col("e"), "generate": F.col("g")})
    reqlog.append_events(out, str(tmp_path / "events"))
    reqlog.append_events(out, str(tmp_path / "events"))
    assert spark.read.parquet(str(tmp_path / "events")).count() == 2


class Slow:
    """Embedder that takes longer than an entry of the test below has left to live."""

    def embed(self, texts):
        import time

        time.sleep(4)
        return [[float(len(t)), 1.0] for t in texts]


def test_entries_that_expire_meanwhile_are_answered(spark, tmp_path):
    """On the real clock: the entry is fresh at the start and expired at the end."""
    path = str(tmp_path / "cache")
    stored = run(spark, Length()).cache_entries
    left = F.current_timestamp() - F.expr("interval 7 seconds")
    one = stored.where("answer.question = 'iki'").withColumn("set_ts", left)
    ans.append_cache(one, path)
    questions = spark.createDataFrame([(1, "iki"), (2, "yeni soru"), (3, " ")], "query_id long, q string")
    corpus = spark.createDataFrame([("p1", "internal", [3.0, 1.0])], "point_id string, collection string, embedding array<double>")
    payload = spark.createDataFrame([("p1", "x")], "point_id string, text string")
    job = ans.answer_questions(
        questions, corpus, payload, Slow(), Scripted(), cache=spark.read.parquet(path),
        params=Params(cache_ttl_seconds=10),
    )
    for _ in range(2):
        got = {r.query_id: (r.cache_event, r.answer is not None) for r in job.answers.collect()}
        assert got[2] == ("miss", True) and got[3] == ("blank", True)
        assert got[1][1] and len(got) == 3
    times = {r.set_ts for r in job.cache_entries.collect()}
    assert len(times) == 1 and times == {r.set_ts for r in job.cache_entries.collect()}


def test_cache_entries_of_the_future_and_ties(spark):
    rows = [("a", "2024-01-01 00:00:05", "x"), ("a", "2024-01-01 00:00:05", "y"), ("b", "2024-01-01 00:00:50", "z")]
    cache = spark.createDataFrame(rows, "cache_key string, set_ts string, answer string")
    now = F.lit("2024-01-01 00:00:10")
    for kind in ("timestamp", "timestamp_ntz"):
        table = cache.withColumn("set_ts", F.col("set_ts").cast(kind))
        found = ans.fresh_entries(table, now.cast(kind), 60).collect()
        assert [tuple(r) for r in found] == [("a", "y")]


def test_vectors_are_made_once(spark, tmp_path):
    """A corpus that a search reads from an embedding is not embedded again."""
    e = Counting(tmp_path / "calls")
    rows = spark.createDataFrame([(f"p{i}", "t" * i) for i in range(1, 9)], "point_id string, text string")
    corpus = md.embed_texts(rows, "text", e, 100).withColumn("collection", F.lit("internal"))
    before = sum(e.calls())
    q = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, embedding array<double>")
    for budget in (1, 1 << 20):
        from rankloom.operators.similarity import search

        assert search(q, corpus, 3, broadcast_bytes=budget).count() == 3
    assert sum(e.calls()) == before == 8
