"""Tunable parameters with their defaults and legal ranges."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Name -> (lowest, highest) accepted by every entry point.
BOUNDS: dict[str, tuple[float, float]] = {
    "top_k": (1, 100),
    "max_context_chunks": (1, 20),
    "max_source_display": (1, 10),
    "source_preview_chars": (50, 2000),
    "rate_limit": (1, 10000),
    "max_body_bytes": (1024, 10485760),
    "cache_ttl_seconds": (10, 86400),
    "cache_max_entries": (1, 10000),
    "temperature": (0.0, 2.0),
    "max_tokens": (1, 8192),
    "embed_batch_size": (1, 2048),
}


@dataclass(frozen=True)
class Params:
    """Defaults of the answer job; ``Params(top_k=3)`` overrides one of them."""

    top_k: int = 5
    max_context_chunks: int = 5
    max_source_display: int = 3
    source_preview_chars: int = 200
    context_chunk_chars: int = 500
    embed_max_chars: int = 8000
    embed_batch_size: int = 100
    rate_limit: int = 60
    rate_window_seconds: int = 60
    max_body_bytes: int = 1048576
    enable_cache: bool = True
    cache_ttl_seconds: int = 300
    cache_max_entries: int = 256
    temperature: float = 0.3
    max_tokens: int = 800
    rrf_k: int = 60
    model: str = "gpt-4"
    embed_provider: str = "openai"
    embed_model: str = "text-embedding-3-small"

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name in BOUNDS:
                check_bound(f.name, getattr(self, f.name))


def check_bound(name: str, value: float) -> None:
    low, high = BOUNDS[name]
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value}")


def effective_top_k(top_k: int | None, params: Params) -> int:
    """``None`` and ``0`` mean the configured default; anything else is checked."""
    chosen = top_k or params.top_k
    check_bound("top_k", chosen)
    return chosen
