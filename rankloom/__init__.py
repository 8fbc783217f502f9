"""Retrieval analytics on Spark: search, fusion, answers and the request log."""

from rankloom.functions.masking import mask, mask_column
from rankloom.functions.vectors import get_embedding_dimension
from rankloom.operators.answers import (
    answer_questions,
    flush_cache,
    generate_answer,
    retrieve_answer,
)
from rankloom.operators.cache_replay import cache_stats
from rankloom.operators.chunk_copies import chunk_copies
from rankloom.operators.fusion import reciprocal_rank_fusion
from rankloom.operators.ingest import chunks
from rankloom.operators.models import embed, embed_batch, embed_texts, generate_answers
from rankloom.operators.similarity import search
from rankloom.sources.collections import collection_exists, get_collection_info

__all__ = [
    "answer_questions",
    "cache_stats",
    "chunk_copies",
    "chunks",
    "collection_exists",
    "embed",
    "embed_batch",
    "embed_texts",
    "flush_cache",
    "generate_answer",
    "generate_answers",
    "get_embedding_dimension",
    "mask",
    "mask_column",
    "reciprocal_rank_fusion",
    "retrieve_answer",
    "search",
    "get_collection_info",
]
