"""The registered query of each operator, with SQL where SQL can express it."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    language,
    mixing,
    oracles,
    pii,
    repeats,
    secret_scan,
    simhash,
    spelling,
    token_counts,
    warc,
    whitening,
)
from rankloom.plans.tables import table

BYTE_BPE = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def _digests(numbers: bytes, ids, text: str) -> tuple[int, str, str]:
    return (
        len(ids),
        hashlib.sha256(numbers).hexdigest(),
        hashlib.sha256(text.encode()).hexdigest(),
    )


def op1_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.round_trip(
        table(spark, d, "documents"),
        public_tokenizers.path(BYTE_BPE),
        "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        _digests,
    )


def op2_secrets(spark: SparkSession, d: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, d, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [
        F.expr(f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS BIGINT) AS n_{kind}")
        for kind in ("assign", "access", "hex")
    ]
    found = found.select("doc_id", *counts, base.alias("base"), "spans")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secret_scan.listed("base"), 256).alias("base_sha256"),
        secret_scan.listed("spans").alias("spans"),
    )


def op3_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.archived_pages(table(spark, d, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op4_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.drop("text_key")


def op5_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, d, "documents"))


def op6_token_counts(spark: SparkSession, d: str) -> DataFrame:
    pieces = token_counts.read_ranks(public_tokenizers.path(BYTE_RANKS))
    return token_counts.token_counts(table(spark, d, "documents"), token_counts.rank_scores(pieces))


def op7_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return language.identify(docs, language.train(docs))


def op8_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


def op9_suffix_arrays(spark: SparkSession, d: str) -> DataFrame:
    made = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return repeats.map_repeats(table(spark, d, "documents"), made, repeats.digests)


def _counted(base: list, added: list) -> tuple:
    digest = hashlib.sha256(pii.listed(base).encode()).hexdigest()
    kinds = [kind for kind, _, _ in base]
    return (*map(kinds.count, pii.KINDS), digest, pii.listed(base + added))


def op10_pii(spark: SparkSession, d: str) -> DataFrame:
    made = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return pii.map_spans(table(spark, d, "documents"), pii.train(), made, _counted)


def op11_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whitened(table(spark, d, "embeddings"))[0]


def op12_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(spelling.spelled_words(table(spark, d, "documents")))


def op13_mixing(spark: SparkSession, d: str) -> DataFrame:
    mix = mixing.mixture(table(spark, d, "documents"), lambda s: mixing.repeating_weights(s, [1, 2, 3]))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_secrets": op2_secrets,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_suffix_arrays": op9_suffix_arrays,
    "op10_pii": op10_pii,
    "op11_whitening": op11_whitening,
    "op12_spelling": op12_spelling,
    "op13_mixing": op13_mixing,
}

SQL = {
    "op2_secrets": oracles.SECRETS,
    "op3_warc": oracles.WARC,
    "op4_decontamination": oracles.LEAKS,
    "op5_exact_dedup": oracles.EXACT_DEDUP,
    "op9_suffix_arrays": oracles.REPEATS,
    "op13_mixing": oracles.MIXTURE,
}
