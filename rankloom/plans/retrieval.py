"""Retrieval, fusion, context and answer queries, each with its SQL definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.operators import answers as ans
from rankloom.operators import context as ctx
from rankloom.operators import fusion as fu
from rankloom.operators.ingest import chunks
from rankloom.operators.models import embed_texts
from rankloom.operators.similarity import search
from rankloom.params import Params
from rankloom.plans import tables as tb
from rankloom.plans.standins import FirstSourceGenerator, LetterCountEmbedder

TOP_K = 5
DOT_THRESHOLD = 0.35
STRICT_THRESHOLD = 0.37
CHUNK_CHARS, CHUNK_OVERLAP = 500, 50


def _hits(spark: SparkSession, d: str, metric: str = "dot", threshold: float | None = None) -> DataFrame:
    return search(tb.vector_questions(spark, d), tb.points(spark, d), TOP_K, metric, threshold)


def _topk(metric: str, threshold: float | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _hits(spark, d, metric, threshold).withColumn("score", F.round("score", 6))

    return run


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    fused = fu.reciprocal_rank_fusion(_hits(spark, d))
    return fused.drop("source").withColumn("fused_score", F.round("fused_score", 9))


def rrf_provenance(spark: SparkSession, d: str) -> DataFrame:
    return fu.reciprocal_rank_fusion(_hits(spark, d)).select("query_id", "point_id", "source")


def rrf_hit_counts(spark: SparkSession, d: str) -> DataFrame:
    return fu.hit_counts(_hits(spark, d))


def rrf_overlap(spark: SparkSession, d: str) -> DataFrame:
    fused = fu.reciprocal_rank_fusion(_hits(spark, d))
    return fu.overlap(fused).select("query_id", "point_id", "fused_rank")


def rrf_exclusive(spark: SparkSession, d: str) -> DataFrame:
    fused = fu.reciprocal_rank_fusion(_hits(spark, d))
    return fu.exclusive(fused, "external").select("query_id", "point_id", "fused_rank")


def retrieval_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Who finds a close neighbour other than itself in either collection."""
    asked = tb.vector_questions(spark, d)
    hits = _hits(spark, d, "dot", STRICT_THRESHOLD)
    others = hits.where(F.col("query_id").cast("string") != F.col("point_id"))
    fused = fu.reciprocal_rank_fusion(others).groupBy("query_id").agg(F.count(F.lit(1)).alias("fused_results"))
    every = asked.select("query_id").join(fused, "query_id", "left")
    return fu.retrieval_outcome(every.fillna(0))


def _with_payload(spark: SparkSession, d: str, fused: DataFrame) -> DataFrame:
    return ctx.attach_payload(fused, tb.payload(spark, d), TOP_K)


def _context(spark: SparkSession, d: str) -> DataFrame:
    fused = fu.reciprocal_rank_fusion(_hits(spark, d))
    return ctx.collect_context(_with_payload(spark, d, fused))


def fused_context(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d).select("query_id", ctx.context_text(F.col("context")).alias("context"))


def fused_sources(spark: SparkSession, d: str) -> DataFrame:
    shown = F.posexplode(ctx.response_sources(F.col("context")))
    return (
        _context(spark, d)
        .select("query_id", shown.alias("pos", "shown"))
        .select("query_id", "pos", "shown.text", "shown.source", "shown.score")
    )


def _asked(column: str = "query_id"):
    return F.concat(F.lit("Soru "), F.col(column).cast("string"))


def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d).select(
        "query_id", ctx.user_prompt(_asked(), F.col("context")).alias("user_prompt")
    )


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Answer records whose answer is the text of the best hit."""
    hits = _hits(spark, d)
    fused = fu.reciprocal_rank_fusion(hits)
    contexts = ctx.collect_context(_with_payload(spark, d, fused))
    none = F.lit(None).cast("string")
    answer = F.struct(
        _asked().alias("question"),
        F.nullif(F.col("context")[0]["text"], F.lit("")).alias("answer"),
        ctx.response_sources(F.col("context")).alias("sources"),
        F.struct(
            "internal_hits",
            "external_hits",
            "fused_results",
            F.lit(None).cast("long").alias("tokens_used"),
            none.alias("model"),
            none.alias("error_type"),
            none.alias("error"),
        ).alias("metadata"),
        none.alias("error"),
    )
    return contexts.join(fu.hit_counts(hits), "query_id").select("query_id", answer.alias("answer"))


def text_report(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("query_id", ctx.text_report(F.col("answer")).alias("report"))


def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    return _records(spark, d).select(
        "query_id", ctx.markdown_report(F.col("answer"), at).alias("report")
    )


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """Everything between full stops in documents and conversations, untrimmed."""
    texts = tb.table(spark, d, "documents").select(
        F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("src"), "text"
    ).unionByName(
        tb.table(spark, d, "conversations").select(
            F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("src"),
            "text",
        )
    )
    return texts.select("src", F.posexplode(F.split("text", r"\.")).alias("pos", "q"))


def question_validation(spark: SparkSession, d: str) -> DataFrame:
    return ans.validate_questions(_sentences(spark, d)).select("src", "pos", "question", "reject_reason")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    asked = tb.text_questions(spark, d)
    key = tx.cache_key(F.col("q"), TOP_K, Params.model)
    return asked.select("query_id", tx.strip(F.col("q")).alias("question"), key.alias("cache_key"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d).select("query_id", "cache_key")


NOW = "2024-01-01 00:06:00"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    """Opening questions were answered before, one second per conversation."""
    opened = tb.table(spark, d, "conversations").where("role = 'user' AND turn = 0")
    return opened.select(
        tx.cache_key(F.col("text"), TOP_K, Params.model).alias("cache_key"),
        F.expr("timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, conv_id)").alias("set_ts"),
        F.concat(F.lit("cached "), F.col("conv_id").cast("string")).alias("answer"),
    )


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    found = ans.cache_lookup(_keyed(spark, d), _cache(spark, d), now, Params.cache_ttl_seconds)
    return found.select("query_id", "cache_event", "answer")


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    return ans.cache_misses(
        _keyed(spark, d), _cache(spark, d), now, Params.cache_ttl_seconds
    ).select("query_id", "question")


def disclaimer_append(spark: SparkSession, d: str) -> DataFrame:
    said = tb.table(spark, d, "conversations")
    # Assistant turns already carry the disclaimer, in front.
    draft = F.when(
        F.col("role") == "assistant", F.concat(F.lit(tx.DISCLAIMER + " "), F.col("text"))
    ).otherwise(F.col("text"))
    return said.select("conv_id", "turn", tx.with_disclaimer(draft).alias("answer"))


def previews(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return tb.table(spark, d, "documents").select(
        "doc_id",
        tx.ellipsize(text, Params.context_chunk_chars).alias("context_text"),
        tx.ellipsize(text, Params.source_preview_chars).alias("source_text"),
        tx.ellipsize(text, 100).alias("log_text"),
        tx.preview(text, 80).alias("table_text"),
        tx.preview(text, 60).alias("history_text"),
        tx.truncate(tx.strip(text), Params.embed_max_chars).alias("embed_text"),
    )


def json_requests(spark: SparkSession, d: str) -> DataFrame:
    """User turns arrive as JSON bodies, other turns as text that is not JSON."""
    body = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("q")))).otherwise(
        F.concat(F.lit("q="), F.col("text"))
    )
    said = tb.table(spark, d, "conversations").withColumn("body", body)
    return said.select("conv_id", "turn", ctx.parse_request(F.col("body")).alias("q"))


def json_messages(spark: SparkSession, d: str) -> DataFrame:
    return tb.table(spark, d, "conversations").select(
        "conv_id", "turn", tx.json_message(F.col("text")).alias("message")
    )


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks(tb.table(spark, d, "documents"), "doc_id", "text", CHUNK_CHARS, CHUNK_OVERLAP)


def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Letters counted by the stand-in embedder; blank pieces keep a null."""
    pieces = embed_texts(_sentences(spark, d), "q", LetterCountEmbedder())
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return pieces.select("src", "pos", total.cast("long").alias("letters"), F.size("embedding").alias("dim"))


def _answer_job(spark: SparkSession, d: str, questions: DataFrame, **options) -> ans.AnswerJob:
    """Questions answered from all documents with the stand-in models."""
    docs = tb.table(spark, d, "documents").select(F.col("doc_id").alias("point_id"), "text", "lang")
    collection = F.when(F.col("lang") == "en", F.lit("internal")).otherwise(F.lit("external"))
    corpus = embed_texts(docs, "text", LetterCountEmbedder()).select(
        "point_id", collection.alias("collection"), "embedding"
    )
    embedder = options.pop("embedder", LetterCountEmbedder())
    return ans.answer_questions(
        questions,
        corpus,
        docs.drop("lang"),
        embedder,
        FirstSourceGenerator(),
        now=F.lit(NOW).cast("timestamp"),
        **options,
    )


def answer_job(spark: SparkSession, d: str) -> DataFrame:
    """Every user turn answered."""
    job = _answer_job(spark, d, tb.text_questions(spark, d))
    listed = F.transform(
        F.col("answer.sources"),
        lambda s: F.concat(s["source"], F.lit(" "), s["score"].cast("string"), F.lit(" "), s["text"]),
    )
    return job.answers.select(
        "query_id",
        "answer.question",
        F.col("answer.answer").alias("answer"),
        F.array_join(listed, "|").alias("sources"),
        "answer.metadata.internal_hits",
        "answer.metadata.external_hits",
        "answer.metadata.fused_results",
        "answer.metadata.tokens_used",
    )


def _with_blanks(spark: SparkSession, d: str) -> DataFrame:
    """User turns, and a blank question for each conversation."""
    blanks = tb.table(spark, d, "conversations").where("turn = 0").select(
        F.concat(F.lit("blank-"), F.col("conv_id").cast("string")).alias("query_id"), F.lit(" \t ").alias("q")
    )
    return tb.text_questions(spark, d).unionByName(blanks)


def _answer_cache(spark: SparkSession, d: str) -> DataFrame:
    """The cache of opening questions, its answers as answer records."""
    record = F.struct(
        F.lit("cached").alias("question"),
        F.col("answer"),
        F.array().alias("sources"),
        F.struct(
            *[F.lit(None).alias(c) for c in ("internal_hits", "external_hits", "fused_results")],
            *[F.lit(None).alias(c) for c in ("tokens_used", "model", "error_type", "error")],
        ).alias("metadata"),
        F.lit(None).alias("error"),
    )
    return _cache(spark, d).withColumn("answer", record.cast(ans.ANSWER_TYPE))


def answer_job_cached(spark: SparkSession, d: str) -> DataFrame:
    """Blank questions, hits, expired entries and misses in one job."""
    job = _answer_job(spark, d, _with_blanks(spark, d), cache=_answer_cache(spark, d))
    return job.answers.select(
        "query_id", "cache_event", F.col("answer.answer").alias("answer"), F.col("answer.error").alias("error")
    )


class _PartlyFailing(LetterCountEmbedder):
    """Stand-in whose service refuses questions with some letters."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        if any("q" in t for t in texts):
            raise ConnectionError("no route")
        if any("x" in t for t in texts):
            raise RuntimeError("broken")
        return super().embed(texts)


def answer_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failures of the embedding stage by kind, one question a call."""
    job = _answer_job(
        spark, d, tb.text_questions(spark, d), embedder=_PartlyFailing(), params=Params(embed_batch_size=1)
    )
    failed = job.answers.where("answer.error IS NOT NULL")
    return failed.select(
        "query_id",
        F.col("answer.answer").alias("answer"),
        F.col("answer.error").alias("error"),
        F.col("answer.metadata.error_type").alias("error_type"),
    )


def answer_stages(spark: SparkSession, d: str) -> DataFrame:
    """How many events each stage of the job wrote, by collection and status."""
    events = _answer_job(spark, d, tb.text_questions(spark, d)).stage_events
    return events.groupBy("stage", "collection", "status").agg(
        F.count(F.lit(1)).alias("events"), F.sum("tokens").alias("tokens")
    )


QUERIES = {
    "topk_dot": _topk("dot"),
    "topk_cosine": _topk("cosine"),
    "topk_euclid": _topk("euclid"),
    "topk_threshold": _topk("dot", DOT_THRESHOLD),
    "rrf_fuse": rrf_fuse,
    "rrf_provenance": rrf_provenance,
    "rrf_hit_counts": rrf_hit_counts,
    "rrf_overlap": rrf_overlap,
    "rrf_exclusive": rrf_exclusive,
    "retrieval_outcome": retrieval_outcome,
    "fused_context": fused_context,
    "fused_sources": fused_sources,
    "prompt_text": prompt_text,
    "text_report": text_report,
    "markdown_report": markdown_report,
    "question_validation": question_validation,
    "cache_keys": cache_keys,
    "cache_lookup": cache_lookup,
    "cache_misses": cache_misses,
    "disclaimer_append": disclaimer_append,
    "previews": previews,
    "json_requests": json_requests,
    "json_messages": json_messages,
    "document_chunks": document_chunks,
    "embed_batches": embed_batches,
    "answer_job": answer_job,
    "answer_job_cached": answer_job_cached,
    "answer_failures": answer_failures,
    "answer_stages": answer_stages,
}


# --- the same in SQL ----------------------------------------------------------

_SCORE = {
    "dot": "list_dot_product(q.v, p.v)",
    "cosine": "list_dot_product(q.v, p.v) / "
    "(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(p.v, p.v)))",
    "euclid": "list_distance(q.v, p.v)",
}


def _hits_sql(metric: str = "dot", threshold: float | None = None) -> str:
    direction = "ASC" if metric == "euclid" else "DESC"
    keep = f"WHERE score >= {threshold}" if threshold is not None else ""
    return f"""
    e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
    p AS (SELECT vec_id, v, 'internal' AS collection FROM e WHERE label <= 5
          UNION ALL SELECT vec_id, v, 'external' FROM e WHERE label >= 4),
    s AS (SELECT q.vec_id AS query_id, p.collection, p.vec_id::VARCHAR AS point_id,
                 {_SCORE[metric]} AS score FROM e q CROSS JOIN p),
    hits AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, collection
                                     ORDER BY score {direction}, point_id) AS rank
        FROM s {keep}) WHERE rank <= {TOP_K})"""


_FUSED_SQL = """
    m AS (SELECT query_id, point_id,
                 sum(CASE WHEN collection = 'internal' THEN 1.0::DOUBLE / (60 + rank) END) AS a,
                 sum(CASE WHEN collection = 'external' THEN 1.0::DOUBLE / (60 + rank) END) AS b,
                 min(CASE WHEN collection = 'internal' THEN rank END) AS internal_rank,
                 min(CASE WHEN collection = 'external' THEN rank END) AS external_rank
          FROM hits GROUP BY query_id, point_id),
    f AS (SELECT query_id, point_id, coalesce(a, 0) + coalesce(b, 0) AS fused_score,
                 CASE WHEN internal_rank IS NOT NULL AND external_rank IS NOT NULL THEN 'both'
                      WHEN internal_rank IS NOT NULL THEN 'internal' ELSE 'external' END AS source,
                 internal_rank, external_rank FROM m),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id
                  ORDER BY fused_score DESC, internal_rank ASC NULLS LAST,
                           external_rank ASC NULLS LAST, point_id) AS fused_rank FROM f)"""

_COUNTS_SQL = """
    counts AS (SELECT query_id, count_if(collection = 'internal') AS internal_hits,
                      count_if(collection = 'external') AS external_hits,
                      count(DISTINCT point_id) AS fused_results FROM hits GROUP BY query_id)"""

_TEXTS_SQL = f"""
    w AS (SELECT fused.*, coalesce(d.text, '') AS text FROM fused
          LEFT JOIN documents d ON d.doc_id::VARCHAR = fused.point_id WHERE fused_rank <= {TOP_K})"""

_CHUNK = """'[Kaynak ' || fused_rank || ']: ' ||
    CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END"""
_SHORT = "CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BEFORE, _AFTER = tx.USER_PROMPT.split("{context}")
_HEAD, _MIDDLE = _BEFORE.split("{question}")
_SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_SENTENCES_SQL = """
    t AS (SELECT 'd-' || doc_id AS src, text FROM documents
          UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations),
    pieces AS (SELECT src, unnest(string_split(text, '.')) AS q,
                      unnest(range(len(string_split(text, '.')))) AS pos FROM t)"""

_KEYED_SQL = f"""
    keyed AS (SELECT conv_id || '-' || turn AS query_id, {_strip_sql('text')} AS question,
                     sha256('q=' || {_strip_sql('text')} || '|topk=5|model=gpt-4') AS cache_key
              FROM conversations WHERE role = 'user')"""
_CACHE_SQL = f"""
    stored AS (SELECT sha256('q=' || {_strip_sql('text')} || '|topk=5|model=gpt-4') AS cache_key,
                      TIMESTAMP '2024-01-01' + to_seconds(conv_id) AS set_ts,
                      'cached ' || conv_id AS answer
               FROM conversations WHERE role = 'user' AND turn = 0),
    entries AS (SELECT cache_key, max(set_ts) AS set_ts, max_by(answer, set_ts) AS answer
                FROM stored GROUP BY cache_key),
    fresh AS (SELECT *, epoch_us(TIMESTAMP '{NOW}') - epoch_us(set_ts) <= 300000000 AS fresh
              FROM entries)"""

_REPORT_SQL = f"""
    shown AS (SELECT query_id,
        string_agg(chr(10) || '[Kaynak ' || fused_rank || '] (' || source || ') - Score: '
                   || round(fused_score, 4)::VARCHAR || chr(10) || '  ' || {_SHORT} || chr(10),
                   chr(10) ORDER BY fused_rank) AS report_lines,
        string_agg('- [Kaynak ' || fused_rank || '] (' || source || '): ' || {_SHORT},
                   chr(10) ORDER BY fused_rank) AS items
        FROM w WHERE fused_rank <= 3 GROUP BY query_id),
    best AS (SELECT query_id, nullif(text, '') AS answer FROM w WHERE fused_rank = 1)"""

_RULE, _LINE = "repeat('=', 80)", "repeat('-', 80)"

_LETTERS = "string_split('abcdefghijklmnopqrstuvwxyz', '')"


def _letter_vector(column: str) -> str:
    return (
        f"list_transform({_LETTERS}, lambda c: "
        f"(length({column}) - length(replace({column}, c, '')))::DOUBLE)"
    )


_ANSWER_SQL = f"""
WITH asked AS (SELECT conv_id || '-' || turn AS query_id, {_strip_sql('text')} AS question
               FROM conversations WHERE role = 'user'),
    qs AS (SELECT question, {_letter_vector('substring(question, 1, 8000)')} AS v
           FROM (SELECT DISTINCT question FROM asked)),
    ps AS (SELECT doc_id::VARCHAR AS point_id, text,
                  CASE WHEN lang = 'en' THEN 'internal' ELSE 'external' END AS collection,
                  {_letter_vector(_strip_sql('text'))} AS v FROM documents),
    qn AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM qs),
    pn AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM ps),
    s AS (SELECT question AS query_id, collection, point_id,
                 list_dot_product(qn.v, pn.v) / (qn.n * pn.n) AS score
          FROM qn CROSS JOIN pn WHERE qn.n > 0 AND pn.n > 0),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection
                            ORDER BY score DESC, point_id) AS rank FROM s) WHERE rank <= 5),
    {_FUSED_SQL}, {_COUNTS_SQL}, {_TEXTS_SQL},
    prompts AS (SELECT query_id,
        {_q(_HEAD)} || query_id || {_q(_MIDDLE)}
        || string_agg({_CHUNK}, chr(10) || chr(10) ORDER BY fused_rank) || {_q(_AFTER)} AS prompt,
        string_agg(source || ' ' || round(fused_score, 4)::VARCHAR || ' ' || {_SHORT}, '|'
                   ORDER BY fused_rank) FILTER (WHERE fused_rank <= 3) AS sources,
        min({_CHUNK}) FILTER (WHERE fused_rank = 1) AS first_chunk
        FROM w GROUP BY query_id),
    done AS (SELECT query_id AS question, split_part(first_chunk, chr(10), 1) || {_q(chr(10) * 2 + tx.DISCLAIMER)} AS answer,
                    sources, length(prompt) // 4 AS tokens_used,
                    internal_hits, external_hits, fused_results
             FROM prompts JOIN counts USING (query_id))
SELECT query_id, question,
       coalesce(answer, {_q(tx.NO_HITS_REPLY + chr(10) * 2 + tx.DISCLAIMER)}) AS answer,
       coalesce(sources, '') AS sources, coalesce(internal_hits, 0) AS internal_hits,
       coalesce(external_hits, 0) AS external_hits, coalesce(fused_results, 0) AS fused_results,
       coalesce(tokens_used, 0) AS tokens_used
FROM asked LEFT JOIN done USING (question)"""


def _topk_sql(metric: str, threshold: float | None = None) -> str:
    return f"""WITH {_hits_sql(metric, threshold)}
    SELECT query_id, collection, point_id, round(score, 6) AS score, rank FROM hits"""


_DISCLAIMER = _q(tx.DISCLAIMER)

SQL = {
    "topk_dot": _topk_sql("dot"),
    "topk_cosine": _topk_sql("cosine"),
    "topk_euclid": _topk_sql("euclid"),
    "topk_threshold": _topk_sql("dot", DOT_THRESHOLD),
    "rrf_fuse": f"""WITH {_hits_sql()}, {_FUSED_SQL}
        SELECT query_id, point_id, round(fused_score, 9) AS fused_score, internal_rank,
               external_rank, fused_rank FROM fused""",
    "rrf_provenance": f"WITH {_hits_sql()}, {_FUSED_SQL} SELECT query_id, point_id, source FROM fused",
    "rrf_hit_counts": f"WITH {_hits_sql()}, {_COUNTS_SQL} SELECT * FROM counts",
    "rrf_overlap": f"""WITH {_hits_sql()}, {_FUSED_SQL}
        SELECT query_id, point_id, fused_rank FROM fused WHERE source = 'both'""",
    "rrf_exclusive": f"""WITH {_hits_sql()}, {_FUSED_SQL}
        SELECT query_id, point_id, fused_rank FROM fused WHERE source = 'external'""",
    "retrieval_outcome": f"""WITH {_hits_sql("dot", STRICT_THRESHOLD)}
        SELECT CASE WHEN vec_id IN (SELECT query_id FROM hits WHERE point_id <> query_id::VARCHAR)
                    THEN 'hit' ELSE 'miss' END AS outcome, count(*) AS questions
        FROM embeddings GROUP BY 1""",
    "fused_context": f"""WITH {_hits_sql()}, {_FUSED_SQL}, {_TEXTS_SQL}
        SELECT query_id, string_agg({_CHUNK}, chr(10) || chr(10) ORDER BY fused_rank) AS context
        FROM w GROUP BY query_id""",
    "fused_sources": f"""WITH {_hits_sql()}, {_FUSED_SQL}, {_TEXTS_SQL}
        SELECT query_id, fused_rank - 1 AS pos, {_SHORT} AS text, source,
               round(fused_score, 4) AS score FROM w WHERE fused_rank <= 3""",
    "prompt_text": f"""WITH {_hits_sql()}, {_FUSED_SQL}, {_TEXTS_SQL}
        SELECT query_id, {_q(_HEAD)} || 'Soru ' || query_id || {_q(_MIDDLE)}
               || string_agg({_CHUNK}, chr(10) || chr(10) ORDER BY fused_rank) || {_q(_AFTER)}
               AS user_prompt FROM w GROUP BY query_id""",
    "text_report": f"""WITH {_hits_sql()}, {_FUSED_SQL}, {_COUNTS_SQL}, {_TEXTS_SQL}, {_REPORT_SQL}
        SELECT query_id, chr(10) || {_RULE} || chr(10) || '📋 SORU:' || chr(10) || {_LINE} || chr(10)
            || 'Soru ' || query_id || chr(10) || chr(10) || '💡 CEVAP:' || chr(10) || {_LINE}
            || chr(10) || coalesce(answer, 'Cevap bulunamadı') || chr(10) || chr(10)
            || '📚 KAYNAKLAR:' || chr(10) || {_LINE} || chr(10) || report_lines || chr(10)
            || 'ℹ️  METAVERİ:' || chr(10) || {_LINE} || chr(10) || 'Model: N/A' || chr(10)
            || 'Tokens: 0' || chr(10) || 'Internal hits: ' || internal_hits || chr(10)
            || 'External hits: ' || external_hits || chr(10) || 'Fused results: ' || fused_results
            || chr(10) || {_RULE} || chr(10) AS report
        FROM shown JOIN best USING (query_id) JOIN counts USING (query_id)""",
    "markdown_report": f"""WITH {_hits_sql()}, {_FUSED_SQL}, {_TEXTS_SQL}, {_REPORT_SQL}
        SELECT query_id, '# RAG — 20240102_030405' || chr(10) || chr(10) || '**Soru:** Soru '
            || query_id || chr(10) || chr(10) || coalesce(answer, '') || chr(10) || chr(10)
            || '## Kaynaklar' || chr(10) || items AS report
        FROM shown JOIN best USING (query_id)""",
    "question_validation": f"""WITH {_SENTENCES_SQL}
        SELECT src, pos, {_strip_sql('q')} AS question,
            CASE WHEN length(q) < 3 THEN 'too_short' WHEN length(q) > 500 THEN 'too_long'
                 WHEN {_strip_sql('q')} = '' THEN 'empty'
                 WHEN length({_strip_sql('q')}) < 3 THEN 'too_short_stripped' END AS reject_reason
        FROM pieces""",
    "cache_keys": f"WITH {_KEYED_SQL} SELECT query_id, cache_key FROM keyed",
    "cache_lookup": f"""WITH {_KEYED_SQL}, {_CACHE_SQL}
        SELECT query_id, CASE WHEN fresh THEN 'hit' WHEN fresh IS NOT NULL THEN 'expired'
                              ELSE 'miss' END AS cache_event,
               CASE WHEN fresh THEN answer END AS answer
        FROM keyed LEFT JOIN fresh USING (cache_key)""",
    "cache_misses": f"""WITH {_KEYED_SQL}, {_CACHE_SQL}
        SELECT query_id, question FROM keyed
        WHERE cache_key NOT IN (SELECT cache_key FROM fresh WHERE fresh)""",
    "disclaimer_append": f"""
        WITH d AS (SELECT conv_id, turn, CASE WHEN role = 'assistant'
                   THEN {_q(tx.DISCLAIMER + ' ')} || text ELSE text END AS draft FROM conversations)
        SELECT conv_id, turn, CASE WHEN contains(draft, {_DISCLAIMER}) THEN draft
               ELSE draft || chr(10) || chr(10) || {_DISCLAIMER} END AS answer FROM d""",
    "previews": f"""SELECT doc_id,
        CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS context_text,
        {_SHORT} AS source_text,
        CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS log_text,
        substring(text, 1, 80) || '...' AS table_text, substring(text, 1, 60) || '...' AS history_text,
        substring({_strip_sql('text')}, 1, 8000) AS embed_text FROM documents""",
    "json_requests": """SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS q
        FROM conversations""",
    "json_messages": """SELECT conv_id, turn, json_object('text', text)::VARCHAR AS message
        FROM conversations""",
    "document_chunks": f"""WITH p AS (SELECT doc_id, text, unnest(range(0, length(text))) AS pos FROM documents)
        SELECT doc_id, pos::INT AS pos,
               substring(text, pos * {CHUNK_CHARS - CHUNK_OVERLAP} + 1, {CHUNK_CHARS}) AS chunk
        FROM p WHERE pos = 0 OR pos * {CHUNK_CHARS - CHUNK_OVERLAP} + {CHUNK_OVERLAP} < length(text)""",
    "embed_batches": f"""WITH {_SENTENCES_SQL}
        SELECT src, pos,
            CASE WHEN {_strip_sql('q')} <> '' THEN length(regexp_replace(q, '[^a-z]', '', 'g')) END AS letters,
            CASE WHEN {_strip_sql('q')} <> '' THEN 26 END AS dim FROM pieces""",
    "answer_job": _ANSWER_SQL,
    "answer_job_cached": f"""WITH {_KEYED_SQL}, {_CACHE_SQL}, made AS ({_ANSWER_SQL})
        SELECT query_id, CASE WHEN fresh THEN 'hit' WHEN fresh IS NOT NULL THEN 'expired'
                              ELSE 'miss' END AS cache_event,
               CASE WHEN fresh THEN fresh.answer ELSE made.answer END AS answer, NULL AS error
        FROM keyed LEFT JOIN fresh USING (cache_key) JOIN made USING (query_id)
        UNION ALL
        SELECT 'blank-' || conv_id, 'blank', {_q(tx.EMPTY_QUESTION_REPLY + chr(10) * 2 + tx.DISCLAIMER)},
               {_q(tx.EMPTY_QUESTION_ERROR)} FROM conversations WHERE turn = 0""",
    "answer_failures": f"""WITH {_KEYED_SQL},
        e AS (SELECT query_id, CASE WHEN contains(question, 'q') THEN 'database'
                     WHEN contains(question, 'x') THEN 'unexpected' END AS error_type FROM keyed)
        SELECT query_id, error_type,
               CASE error_type WHEN 'database' THEN {_q(tx.STAGE_FAILURE_REPLIES["database"] + chr(10) * 2 + tx.DISCLAIMER)}
                    ELSE {_q(tx.STAGE_FAILURE_REPLIES["unexpected"] + chr(10) * 2 + tx.DISCLAIMER)} END AS answer,
               CASE error_type WHEN 'database' THEN {_q(tx.STAGE_FAILURE_PREFIXES["database"] + "no route")}
                    ELSE {_q(tx.STAGE_FAILURE_PREFIXES["unexpected"] + "broken")} END AS error
        FROM e WHERE error_type IS NOT NULL""",
    "answer_stages": f"""WITH a AS (SELECT DISTINCT question, fused_results, tokens_used FROM ({_ANSWER_SQL})),
        s AS (SELECT CASE WHEN fused_results > 0 THEN 'ok' ELSE 'no_hits' END AS status, tokens_used FROM a),
        k AS (SELECT 'embed' AS stage, NULL AS collection UNION ALL SELECT 'search', 'internal'
              UNION ALL SELECT 'search', 'external' UNION ALL SELECT 'generate', NULL UNION ALL SELECT 'total', NULL)
        SELECT stage, collection, status, count(*) AS events,
               sum(CASE WHEN stage = 'generate' THEN tokens_used END)::BIGINT AS tokens
        FROM s CROSS JOIN k WHERE stage <> 'generate' OR status = 'ok' GROUP BY ALL""",
}
