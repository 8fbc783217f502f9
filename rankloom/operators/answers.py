"""The question-to-answer job over a table of questions."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.operators import context as ctx
from rankloom.operators.fusion import hit_counts, reciprocal_rank_fusion
from rankloom.operators.models import Embedder, Generator, embed_distinct, generate_answers
from rankloom.operators.similarity import COLLECTIONS, search
from rankloom.params import Params, check_bound, effective_top_k
from rankloom.session import settle
from rankloom.sources.reqlog import stage_events

# Fixed layout of an answer record.
ANSWER_TYPE = (
    "struct<question:string,answer:string,"
    "sources:array<struct<text:string,source:string,score:double>>,"
    "metadata:struct<internal_hits:long,external_hits:long,fused_results:long,"
    "tokens_used:long,model:string,error_type:string,error:string>,error:string>"
)


@dataclass(frozen=True)
class AnswerJob:
    """``answers (query_id, cache_event, answer)``, ``cache_entries`` to append to the
    cache table and the ``stage_events`` of the questions that were computed."""

    answers: DataFrame
    cache_entries: DataFrame
    stage_events: DataFrame


def validate_questions(questions: DataFrame) -> DataFrame:
    """Add ``question`` (stripped) and ``reject_reason`` (null when acceptable)."""
    return questions.withColumn("question", tx.strip(F.col("q"))).withColumn(
        "reject_reason", tx.question_problem(F.col("q"))
    )


def fresh_entries(cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """``(cache_key, answer)``: the newest entry of each key that is at most TTL old.

    The age is a bound on ``set_ts`` in its own type, which reaches the scan of the
    cache table. Entries set after ``now`` are not seen. Of entries set at the same
    time the greatest answer counts.
    """
    kind = cache.schema["set_ts"].dataType
    oldest = now.cast("timestamp") - F.make_dt_interval(secs=F.lit(ttl_seconds))
    newest = F.max(F.struct("set_ts", "answer"))["answer"]
    return (
        cache.where((F.col("set_ts") >= oldest.cast(kind)) & (F.col("set_ts") <= now.cast(kind)))
        .groupBy("cache_key")
        .agg(newest.alias("answer"))
    )


def frozen(spark: SparkSession, now: Column | None) -> Column:
    """The moment of ``now`` (default: this one) as a literal of the same type.

    Every job of a run, however long it takes, then compares with the same moment.
    """
    now = F.current_timestamp() if now is None else now
    moment = spark.range(1).select(now.alias("now"))
    micros = moment.select(F.unix_micros(F.col("now").cast("timestamp"))).first()[0]
    return F.timestamp_micros(F.lit(micros)).cast(moment.schema["now"].dataType)


def cache_lookup(keyed: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Add ``cache_event`` (hit, expired, miss) and the cached ``answer`` of hits.

    Old entries are needed to tell expired from miss only, so their answers are
    not read.
    """
    check_bound("cache_ttl_seconds", ttl_seconds)
    fresh = fresh_entries(cache, now, ttl_seconds).withColumn("_fresh", F.lit(True))
    seen = F.col("set_ts") <= now.cast(cache.schema["set_ts"].dataType)
    known = cache.where(seen).select("cache_key").distinct().withColumn("_known", F.lit(True))
    event = (
        F.when(F.col("_fresh"), F.lit("hit"))
        .when(F.col("_known"), F.lit("expired"))
        .otherwise(F.lit("miss"))
    )
    return (
        keyed.join(fresh, "cache_key", "left")
        .join(known, "cache_key", "left")
        .withColumn("cache_event", event)
        .drop("_fresh", "_known")
    )


def cache_misses(keyed: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Questions without a fresh cache entry."""
    check_bound("cache_ttl_seconds", ttl_seconds)
    fresh = fresh_entries(cache, now, ttl_seconds)
    return keyed.join(fresh.select("cache_key"), "cache_key", "left_anti")


def blank_answer(disclaimer: str = tx.DISCLAIMER) -> Column:
    return F.struct(
        F.lit("").alias("question"),
        tx.reply(tx.EMPTY_QUESTION_REPLY, disclaimer).alias("answer"),
        F.array().alias("sources"),
        F.struct(
            *[F.lit(None).alias(c) for c in ("internal_hits", "external_hits", "fused_results")],
            F.lit(None).alias("tokens_used"),
            F.lit(None).alias("model"),
            F.lit(None).alias("error_type"),
            F.lit("Empty question").alias("error"),
        ).alias("metadata"),
        F.lit(tx.EMPTY_QUESTION_ERROR).alias("error"),
    ).cast(ANSWER_TYPE)


def failure_reply(error_type: Column, disclaimer: str = tx.DISCLAIMER) -> Column:
    out = F.lit(None)
    for kind, text in tx.STAGE_FAILURE_REPLIES.items():
        out = F.when(error_type == kind, tx.reply(text, disclaimer)).otherwise(out)
    return out


def failure_message(error_type: Column, detail: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, prefix in tx.STAGE_FAILURE_PREFIXES.items():
        out = F.when(error_type == kind, F.concat(F.lit(prefix), detail)).otherwise(out)
    return out


def answer_questions(
    questions: DataFrame,
    points: DataFrame,
    payload: DataFrame,
    embedder: Embedder,
    generator: Generator,
    now: Column | None = None,
    cache: DataFrame | None = None,
    top_k: int | None = None,
    params: Params = Params(),
    metric: str = "cosine",
    collections: Iterable[str] = COLLECTIONS,
    parallel_calls: int | None = None,
) -> AnswerJob:
    """Answer ``(query_id, q)`` rows, one answer for each.

    Equal questions are computed once. The cache is read once, at one moment, and what
    was found is written down, so each question is either a hit or computed. Both model
    stages are written down before anything reads them, so no call is repeated. Failures
    of the model stages end up in the answer rows, by stage.
    """
    top_k = effective_top_k(top_k, params)
    collections = list(collections)
    now = frozen(questions.sparkSession, now)
    keyed = questions.select("query_id", tx.strip(F.col("q")).alias("question")).withColumn(
        "cache_key", tx.cache_key(F.col("question"), top_k, params.model)
    )
    blank = keyed.where(F.col("question") == "")
    asked = keyed.where(F.col("question") != "")
    if cache is not None and params.enable_cache:
        looked_up = settle(cache_lookup(asked, cache, now, params.cache_ttl_seconds))
    else:
        looked_up = asked.withColumn("cache_event", F.lit("miss")).withColumn(
            "answer", F.lit(None).cast(ANSWER_TYPE)
        )
    todo = settle(
        looked_up.where("cache_event <> 'hit'")
        .groupBy("cache_key")
        .agg(F.any_value("question").alias("question"))
    )
    computed = _compute(
        todo, points, payload, embedder, generator, top_k, params, metric, collections,
        parallel_calls,
    )
    found = looked_up.where("cache_event = 'hit'").select("query_id", "cache_event", "answer")
    made = (
        looked_up.where("cache_event <> 'hit'")
        .drop("answer")
        .join(computed.select("cache_key", "answer"), "cache_key")
        .select("query_id", "cache_event", "answer")
    )
    blanks = blank.select(
        "query_id", F.lit("blank").alias("cache_event"), blank_answer().alias("answer")
    )
    entries = computed.where("cacheable").select("cache_key", now.alias("set_ts"), "answer")
    events = stage_events(
        computed,
        now,
        F.lit(generator.model),
        {
            "embed": F.col("embed_seconds"),
            **{f"search/{name}": F.col("search_seconds") for name in collections},
            "generate": F.col("generate_seconds"),
            "total": F.col("total_seconds"),
        },
    )
    return AnswerJob(found.unionByName(made).unionByName(blanks), entries, events)


def _compute(
    todo: DataFrame,
    points: DataFrame,
    payload: DataFrame,
    embedder: Embedder,
    generator: Generator,
    top_k: int,
    params: Params,
    metric: str,
    collections: Iterable[str],
    parallel_calls: int | None,
) -> DataFrame:
    """``(cache_key, answer, cacheable, status, tokens, *_seconds)`` per distinct question."""
    vectors = settle(
        embed_distinct(
            todo, "question", embedder, params.embed_batch_size, params.embed_max_chars, parallel_calls
        )
    )
    embedded = todo.withColumn(
        "_text_key", F.sha2(F.substring("question", 1, params.embed_max_chars), 256)
    ).join(vectors, "_text_key").drop("_text_key")
    query_vectors = embedded.select(F.col("cache_key").alias("query_id"), "embedding")
    # Counts and context both read the ranked lists, k rows per question and collection.
    began = time.perf_counter()
    hits = settle(search(query_vectors, points, top_k, metric, collections=collections))
    asked = embedded.where("embedding IS NOT NULL").count()
    search_seconds = (time.perf_counter() - began) / max(1, asked)
    fused = reciprocal_rank_fusion(hits, params.rrf_k)
    with_text = ctx.attach_payload(fused, payload, top_k)
    contexts = settle(ctx.collect_context(with_text))
    known = (
        embedded.select("cache_key", "question", "embed_error_type", "embed_error", "embed_seconds")
        .withColumnRenamed("cache_key", "query_id")
        .join(hit_counts(hits), "query_id", "left")
        .join(contexts, "query_id", "left")
        .withColumnRenamed("query_id", "cache_key")
    )
    has_hits = F.col("context").isNotNull()
    prompts = known.select(
        "cache_key",
        F.when(has_hits, ctx.system_prompt()).alias("system_prompt"),
        F.when(has_hits, ctx.user_prompt(F.col("question"), F.col("context"), params)).alias(
            "user_prompt"
        ),
    ).where(has_hits)
    generated = settle(
        generate_answers(prompts, generator, params, parallel_calls=parallel_calls).drop(
            "system_prompt", "user_prompt"
        )
    )
    # All questions are searched together; each is booked an equal part of that time.
    searched = F.when(F.col("embed_error_type").isNull(), F.lit(search_seconds))
    total = sum(F.coalesce(c, F.lit(0.0)) for c in (F.col("embed_seconds"), searched, F.col("generate_seconds")))
    return known.join(generated, "cache_key", "left").select(
        "cache_key",
        *_record(params),
        "embed_seconds",
        searched.alias("search_seconds"),
        "generate_seconds",
        total.alias("total_seconds"),
    )


def _record(params: Params) -> list[Column]:
    failed = F.coalesce("embed_error_type", "error_type")
    detail = F.coalesce("embed_error", F.when(F.col("error_type").isNotNull(), F.col("error")))
    no_hits = F.col("context").isNull()
    zero = F.lit(0).cast("long")
    count = lambda name: F.when(failed.isNull(), F.coalesce(F.col(name), zero))
    answer = F.struct(
        F.col("question").alias("question"),
        F.when(failed.isNotNull(), failure_reply(failed))
        .when(no_hits, tx.reply(tx.NO_HITS_REPLY))
        .otherwise(F.col("answer"))
        .alias("answer"),
        F.when(failed.isNull() & ~no_hits, ctx.response_sources(F.col("context"), params))
        .otherwise(F.array().cast("array<struct<text:string,source:string,score:double>>"))
        .alias("sources"),
        F.struct(
            count("internal_hits").alias("internal_hits"),
            count("external_hits").alias("external_hits"),
            count("fused_results").alias("fused_results"),
            count("tokens_used").alias("tokens_used"),
            F.when(failed.isNull(), F.coalesce("model", F.lit(params.model))).alias("model"),
            failed.alias("error_type"),
            F.lit(None).cast("string").alias("error"),
        ).alias("metadata"),
        F.when(failed.isNotNull(), failure_message(failed, detail))
        .otherwise(F.col("error"))
        .alias("error"),
    )
    status = (
        F.when(failed.isNotNull(), failed)
        .when(no_hits, F.lit("no_hits"))
        .when(F.col("error").isNotNull(), F.lit("model_failure"))
        .otherwise(F.lit("ok"))
    )
    return [
        answer.cast(ANSWER_TYPE).alias("answer"),
        # Replies without context and stage failures are not worth keeping.
        (failed.isNull() & ~no_hits).alias("cacheable"),
        status.alias("status"),
        F.coalesce("tokens_used", zero).alias("tokens"),
    ]


def retrieve_answer(
    spark: SparkSession,
    q: str,
    points: DataFrame,
    payload: DataFrame,
    embedder: Embedder,
    generator: Generator,
    **options,
) -> dict:
    """Answer one question; for many, pass them to ``answer_questions`` together."""
    questions = spark.createDataFrame([(0, q)], "query_id long, q string")
    job = answer_questions(questions, points, payload, embedder, generator, **options)
    return job.answers.first()["answer"].asDict(recursive=True)


def generate_answer(
    spark: SparkSession,
    question: str,
    context: list[dict],
    generator: Generator,
    params: Params = Params(),
) -> dict:
    """Answer one question from given chunks (dicts with ``text``)."""
    chunks = [(str(c.get("text") or ""),) for c in context]
    row = spark.createDataFrame(
        [(question, chunks)], "question string, context array<struct<text:string>>"
    )
    asked = F.size("context") > 0
    prompts = row.select(
        F.when(asked, ctx.system_prompt()).alias("system_prompt"),
        F.when(asked, ctx.user_prompt(F.col("question"), F.col("context"), params)).alias("user_prompt"),
    )
    out = generate_answers(prompts, generator, params).first()
    return {c: out[c] for c in ("answer", "tokens_used", "model", "error", "error_type")}


def flush_cache(spark: SparkSession, path: str) -> int:
    """Empty a cache table; the number of entries it held."""
    held = spark.read.parquet(path)
    count, schema = held.count(), held.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return count


def append_cache(entries: DataFrame, path: str) -> None:
    """Store answers for later runs. Each run appends; lookups take the newest."""
    entries.write.mode("append").parquet(path)
