"""Batch embedding and answer generation with pluggable model callables.

A model object is shipped to the tasks and called there; Spark partitions the
distinct inputs. ``parallel_calls`` limits how many tasks call at the same time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from functools import partial
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.functions.masking import mask
from rankloom.params import BOUNDS, Params
from rankloom.session import settle

ATTEMPTS = 3


class ModelError(Exception):
    """The model service refused or failed a call; the call may be repeated."""


class EmbeddingError(Exception):
    """Embedding failed for good."""


class AnswerError(Exception):
    """An answer could not be produced for another reason than the model service."""


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    model: str

    def generate(
        self, system: str, user: str, temperature: float, max_tokens: int
    ) -> tuple[str, int]:
        """Answer text and tokens used."""
        ...


def select_embedder(provider: str, providers: dict[str, Embedder]) -> Embedder:
    """The embedder of a provider setting; the local setting falls back to the remote one."""
    if provider in ("openai", "bge-m3"):
        return providers["openai"]
    raise ValueError(f"Unknown embed_provider: {provider}")


def with_retries(
    call: Callable, *args, attempts: int = ATTEMPTS, base: float = 0.2, sleep: Callable = time.sleep
):
    """Call; on ``ModelError`` wait ``base x 2^attempt`` and repeat, then raise."""
    for attempt in range(attempts):
        try:
            return call(*args)
        except ModelError:
            if attempt == attempts - 1:
                raise
            sleep(base * 2**attempt)


# --- one text or one list -------------------------------------------------------

# Fixed texts: what refused inputs and failed calls say.
EMPTY_TEXT = "Cannot embed empty text"
EMPTY_LIST = "Cannot embed empty list of texts"
ALL_BLANK = "All texts are empty after filtering"
ONE_FAILED = "Failed to generate embedding: {}"
BATCH_FAILED = "Failed to generate batch embeddings: {}"


def _vectors(texts: list[str], embedder: Embedder, size: int, chars: int | None) -> list:
    """Vectors of some texts through the table form; its first failure is raised."""
    spark = SparkSession.active()
    rows = spark.createDataFrame(list(enumerate(texts)), "place long, text string")
    out = embed_texts(rows, "text", embedder, size, chars).orderBy("place").collect()
    for row in out:
        if row["embed_error"] is not None:
            raise EmbeddingError(row["embed_error"])
    return [row["embedding"] for row in out if row["embedding"] is not None]


def embed(text: str, embedder: Embedder, max_chars: int = Params.embed_max_chars) -> list[float]:
    """The vector of one text; for many use ``embed_texts``."""
    if not text.strip():
        raise ValueError(EMPTY_TEXT)
    try:
        return _vectors([text], embedder, 1, max_chars)[0]
    except EmbeddingError as e:
        detail = str(e).removeprefix(BATCH_FAILED.format(""))
        raise EmbeddingError(ONE_FAILED.format(detail)) from e


def embed_batch(
    texts: list[str], embedder: Embedder, batch_size: int = Params.embed_batch_size
) -> list[list[float]]:
    """Vectors of the non-blank texts, in order; blanks have no place in the result."""
    _check_batch_size(batch_size)
    if not texts:
        raise ValueError(EMPTY_LIST)
    vectors = _vectors(texts, embedder, batch_size, None)
    if not vectors:
        raise ValueError(ALL_BLANK)
    return vectors


def _check_batch_size(batch_size: int) -> None:
    low, high = BOUNDS["embed_batch_size"]
    if not low <= batch_size <= high:
        raise ValueError(f"batch_size must be between {low} and {high}, got {batch_size}")


# --- tables -------------------------------------------------------------------


def embed_texts(
    rows: DataFrame,
    text: str,
    embedder: Embedder,
    batch_size: int = Params.embed_batch_size,
    max_chars: int | None = None,
    parallel_calls: int | None = None,
    masking_key: str | None = None,
) -> DataFrame:
    """Add ``embedding``, ``embed_error_type``, ``embed_error`` and ``embed_seconds``.

    With ``masking_key`` the model sees texts whose personal data is masked; ``text`` itself stays.

    Equal texts are embedded once, and the vectors are written down before they are read,
    so no later job calls the model again. Blank texts keep their row, with a null
    vector. A failed batch marks its rows instead of failing the job.
    """
    vectors = settle(embed_distinct(rows, text, embedder, batch_size, max_chars, parallel_calls, masking_key))
    keyed = rows.withColumn("_text_key", F.sha2(_prepared(text, max_chars, masking_key), 256))
    return keyed.join(vectors, "_text_key", "left").drop("_text_key")


def _prepared(text: str, max_chars: int | None, masking_key: str | None = None):
    bare = tx.strip(F.col(text))
    if masking_key is not None:
        bare = mask(bare, masking_key)
    return bare if max_chars is None else F.substring(bare, 1, max_chars)


def embed_distinct(
    rows: DataFrame,
    text: str,
    embedder: Embedder,
    batch_size: int = Params.embed_batch_size,
    max_chars: int | None = None,
    parallel_calls: int | None = None,
    masking_key: str | None = None,
) -> DataFrame:
    """One row per distinct non-blank text, keyed by the hash of the text as the model sees it."""
    _check_batch_size(batch_size)
    distinct = (
        rows.where(tx.strip(F.col(text)) != "")
        .select(_prepared(text, max_chars, masking_key).alias("_text"))
        .groupBy(F.sha2("_text", 256).alias("_text_key"))
        .agg(F.any_value("_text").alias("_text"))
    )
    if parallel_calls:
        distinct = distinct.repartition(parallel_calls, "_text_key")
    return distinct.mapInArrow(
        partial(_embed_partition, embedder, batch_size),
        "_text_key string, embedding array<double>, embed_error_type string, embed_error string, "
        "embed_seconds double",
    )


def _batches(batches: Iterable[pa.RecordBatch], size: int) -> Iterable[pa.Table]:
    """Tables of exactly ``size`` rows (the last one shorter), across Arrow batches."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= size:
            whole = pa.Table.from_batches(held)
            full = count - count % size
            for start in range(0, full, size):
                yield whole.slice(start, size)
            held, count = whole.slice(full).to_batches(), count - full
    if count:
        yield pa.Table.from_batches(held)


def _embed_partition(embedder: Embedder, batch_size: int, batches: Iterable[pa.RecordBatch]):
    for table in _batches(batches, batch_size):
        rows = table.num_rows
        began = time.perf_counter()
        vectors, kind, problem = [], "embedding", "no vector returned"
        try:
            vectors = with_retries(embedder.embed, table["_text"].to_pylist())[:rows]
        except ModelError as e:
            problem = BATCH_FAILED.format(e)
        except ConnectionError as e:
            kind, problem = "database", str(e)
        except Exception as e:  # the row carries what went wrong
            kind, problem = "unexpected", str(e)
        seconds = (time.perf_counter() - began) / rows
        done = len(vectors)
        # Rows beyond the returned vectors stay null and say why.
        widths = [len(v) for v in vectors] + [0] * (rows - done)
        values = np.concatenate([np.asarray(v, np.float64) for v in vectors]) if done else []
        missing = pa.array([False] * done + [True] * (rows - done))
        offsets = pa.array(np.concatenate([[0], np.cumsum(widths)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                table["_text_key"].combine_chunks(),
                pa.ListArray.from_arrays(offsets, pa.array(values, pa.float64()), mask=missing),
                pa.array([None] * done + [kind] * (rows - done), pa.string()),
                pa.array([None] * done + [problem] * (rows - done), pa.string()),
                pa.array([seconds] * rows, pa.float64()),
            ],
            names=["_text_key", "embedding", "embed_error_type", "embed_error", "embed_seconds"],
        )


def generate_answers(
    rows: DataFrame,
    generator: Generator,
    params: Params = Params(),
    system: str = "system_prompt",
    user: str = "user_prompt",
    disclaimer: str = tx.DISCLAIMER,
    parallel_calls: int | None = None,
) -> DataFrame:
    """Add ``answer, tokens_used, model, error, error_type, generate_seconds``.

    Rows with a null user prompt have no context: they get the fixed reply and no
    model call. A model failure becomes an apology with ``error`` and 0 tokens;
    any other failure is left to the caller as ``error_type``.
    """
    model = generator.model
    schema = (
        "answer string, tokens_used long, model string, error string, error_type string, "
        "generate_seconds double"
    )
    plain = rows.where(F.col(user).isNull()).select(
        "*",
        tx.reply(tx.NO_CONTEXT_REPLY, disclaimer).alias("answer"),
        F.lit(0).cast("long").alias("tokens_used"),
        F.lit(model).alias("model"),
        *[F.lit(None).cast("string").alias(c) for c in ("error", "error_type")],
        F.lit(None).cast("double").alias("generate_seconds"),
    )
    asked = rows.where(F.col(user).isNotNull())
    if parallel_calls:
        asked = asked.repartition(parallel_calls)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    raw = asked.mapInPandas(partial(_generate_partition, generator, params, system, user), f"{fields}, {schema}")
    finished = raw.withColumn(
        "answer",
        F.when(F.col("error_type") == "model", tx.reply(tx.MODEL_FAILURE_REPLY, disclaimer)).when(
            F.col("error_type").isNull(), tx.with_disclaimer(F.col("answer"), disclaimer)
        ),
    ).withColumn("error_type", F.nullif(F.col("error_type"), F.lit("model")))
    return finished.unionByName(plain)


def _generate_partition(
    generator: Generator, params: Params, system: str, user: str, frames: Iterable[pd.DataFrame]
):
    settings = (params.temperature, params.max_tokens)
    for frame in frames:
        answers, tokens, errors, kinds, seconds = [], [], [], [], []
        for s, u in zip(frame[system], frame[user]):
            began = time.perf_counter()
            answer, used, error, kind = None, 0, None, None
            try:
                answer, used = with_retries(generator.generate, s, u, *settings)
            except ModelError as e:
                error, kind = f"OpenAI error: {e}", "model"
            except ConnectionError as e:
                error, kind = str(e), "database"
            except AnswerError as e:
                error, kind = str(e), "rag"
            except Exception as e:  # the row carries what went wrong
                error, kind = str(e), "unexpected"
            answers.append(answer)
            tokens.append(used)
            errors.append(error)
            kinds.append(kind)
            seconds.append(time.perf_counter() - began)
        yield frame.assign(
            answer=answers,
            tokens_used=tokens,
            model=generator.model,
            error=errors,
            error_type=kinds,
            generate_seconds=seconds,
        )
