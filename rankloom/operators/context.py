"""From fused hits to context, prompt and response columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.operators.idfilter import passing, wanted_bits
from rankloom.params import Params


def attach_payload(
    fused: DataFrame,
    payload: DataFrame,
    top_k: int,
) -> DataFrame:
    """The ``top_k`` fused hits of each question with ``text`` and ``metadata``.

    ``payload``: ``point_id, text`` and optionally ``metadata`` and
    ``collection``; with a collection, the internal copy wins for ids found in
    both. Ids without payload get empty text and an empty map.

    The texts are the widest column of the system, so they are joined last and
    only for winners: a filter of the winners' ids, of bounded size, is sent to the
    payload scan, so little else is shuffled.
    """
    winners = fused.where(F.col("fused_rank") <= top_k)
    keys = ["point_id"]
    if "collection" in payload.columns:
        keys = ["point_id", "collection"]
        winners = winners.withColumn(
            "collection",
            F.when(F.col("source") == "both", F.lit("internal")).otherwise(F.col("source")),
        )
    if "metadata" not in payload.columns:
        payload = payload.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    texts = payload.select(
        *[F.col(c).cast("string").alias(c) for c in keys], "text", "metadata"
    )
    texts = passing(texts, keys, wanted_bits(winners, keys))
    joined = winners.join(texts, keys, "left")
    return joined.select(
        *fused.columns,
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def collect_context(hits: DataFrame) -> DataFrame:
    """One row per question: ``context``, an array of hits in fused order.

    At most ``top_k`` (100) hits per question reach the array.
    """
    chunk = F.struct(
        F.col("fused_rank").alias("pos"),
        "text",
        "source",
        F.col("fused_score").alias("score"),
        "metadata",
    )
    # Maps cannot be ordered, so the array is sorted on its position alone.
    by_position = lambda a, b: (a["pos"] - b["pos"]).cast("int")
    return hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(chunk), by_position).alias("context")
    )


def context_text(
    context: Column, params: Params = Params(), label: str = tx.CITATION_LABEL
) -> Column:
    """The first chunks, cut, numbered from 1 and separated by blank lines."""

    def line(chunk: Column, i: Column) -> Column:
        return F.concat(
            tx.citation(i + 1, label),
            F.lit(": "),
            tx.ellipsize(chunk["text"], params.context_chunk_chars),
        )

    return F.array_join(
        F.transform(F.slice(context, 1, params.max_context_chunks), line), "\n\n"
    )


def user_prompt(question: Column, context: Column, params: Params = Params()) -> Column:
    return tx.prompt(tx.USER_PROMPT, question=question, context=context_text(context, params))


def system_prompt(disclaimer: str = tx.DISCLAIMER) -> Column:
    return F.lit(tx.SYSTEM_PROMPT.replace("{disclaimer}", disclaimer))


def response_sources(context: Column, params: Params = Params()) -> Column:
    """The displayed sources: text preview, provenance, score to four places."""
    return F.transform(
        F.slice(context, 1, params.max_source_display),
        lambda c: F.struct(
            tx.ellipsize(c["text"], params.source_preview_chars).alias("text"),
            c["source"].alias("source"),
            F.round(c["score"], 4).alias("score"),
        ),
    )


# Layout of the plain-text report and of the markdown export.
_REPORT_RULE = "=" * 80
_REPORT_LINE = "-" * 80
NO_ANSWER = "Cevap bulunamadı"


def text_report(answer: Column) -> Column:
    """Plain-text report of an answer record struct; missing fields show N/A or 0."""
    meta = answer["metadata"]
    number = lambda c: F.coalesce(c.cast("string"), F.lit("0"))
    sources = F.transform(
        answer["sources"],
        lambda s, i: F.concat(
            F.lit("\n"),
            tx.citation(i + 1),
            F.lit(" ("),
            s["source"],
            F.lit(") - Score: "),
            s["score"].cast("string"),
            F.lit("\n  "),
            s["text"],
            F.lit("\n"),
        ),
    )
    source_part = F.when(
        F.size(answer["sources"]) > 0,
        F.concat(F.lit(f"📚 KAYNAKLAR:\n{_REPORT_LINE}\n"), F.array_join(sources, "\n"), F.lit("\n")),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit(f"\n{_REPORT_RULE}\n📋 SORU:\n{_REPORT_LINE}\n"),
        F.coalesce(answer["question"], F.lit("")),
        F.lit(f"\n\n💡 CEVAP:\n{_REPORT_LINE}\n"),
        F.coalesce(answer["answer"], F.lit(NO_ANSWER)),
        F.lit("\n\n"),
        source_part,
        F.lit(f"ℹ️  METAVERİ:\n{_REPORT_LINE}\nModel: "),
        F.coalesce(meta["model"], F.lit("N/A")),
        F.lit("\nTokens: "),
        number(meta["tokens_used"]),
        F.lit("\nInternal hits: "),
        number(meta["internal_hits"]),
        F.lit("\nExternal hits: "),
        number(meta["external_hits"]),
        F.lit("\nFused results: "),
        number(meta["fused_results"]),
        F.lit(f"\n{_REPORT_RULE}\n"),
    )


def markdown_report(answer: Column, ts: Column, title: str = "RAG") -> Column:
    """Markdown export of an answer record with one list item per source."""
    items = F.transform(
        answer["sources"],
        lambda s, i: F.concat(
            F.lit("- "), tx.citation(i + 1), F.lit(" ("), s["source"], F.lit("): "),
            F.coalesce(s["text"], F.lit("")),
        ),
    )
    return F.concat(
        F.lit(f"# {title} — "),
        tx.file_stamp(ts),
        F.lit("\n\n**Soru:** "),
        F.coalesce(answer["question"], F.lit("")),
        F.lit("\n\n"),
        F.coalesce(answer["answer"], F.lit("")),
        F.when(
            F.size(answer["sources"]) > 0,
            F.concat(F.lit("\n\n## Kaynaklar\n"), F.array_join(items, "\n")),
        ).otherwise(F.lit("")),
    )


def write_markdown(answers: DataFrame, path: str) -> None:
    """One text row per answer; ``answers`` holds ``answer`` structs and ``ts``."""
    answers.select(markdown_report(F.col("answer"), F.col("ts")).alias("value")).write.mode(
        "append"
    ).text(path, lineSep="\n\n")


def json_response(answer: Column) -> Column:
    return F.to_json(answer)


def parse_request(body: Column) -> Column:
    """The question text of a JSON request body; null when absent or not JSON."""
    return F.from_json(body, "q string")["q"]
