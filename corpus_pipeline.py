"""From raw documents to token ids: language, copies, near copies, benchmark leaks, tokens.

``STAGES`` are applied in order; each works on all that the one before it kept. All but
the last return rows of ``documents`` with all their columns.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import bpe, decontaminate, exact_dedup, language
from rankloom.llm.common import written
from rankloom.llm.near_copies import one_of_each
from rankloom.plans.tables import table
from rankloom.session import ship_package


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without any letter: no language can be told. Others stay if nothing was learnt."""
    ship_package(spark)
    model = language.train(docs)
    return language.determined(docs, model) if model.languages else language.lettered(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space keep the longest, then the smallest doc_id."""
    ship_package(spark)
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word similarity of 0.8 or more keep the smallest doc_id.

    SimHash links first, verified; an exact step finds the pairs that fingerprints miss.
    """
    ship_package(spark)
    return one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark."""
    ship_package(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def _digests(numbers: bytes, ids, text: str) -> tuple:
    return (
        ids,
        len(ids),
        hashlib.sha256(numbers).hexdigest(),
        hashlib.sha256(text.encode()).hexdigest(),
    )


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text they decode to."""
    ship_package(spark)
    made = "ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), made, _digests)


STAGES = [
    ("language", known_language),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("bpe", tokens),
]

#: SQL can express neither fingerprints' components nor the tokens; tests compare by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
