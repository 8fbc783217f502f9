"""Vector expressions on ``ARRAY<FLOAT|DOUBLE>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted metric spellings. Anything else means cosine.
METRIC_NAMES = {
    "cosine": "cosine",
    "dot": "dot",
    "dotproduct": "dot",
    "dot_product": "dot",
    "euclid": "euclid",
    "euclidean": "euclid",
}


def metric_name(name: str) -> str:
    return METRIC_NAMES.get(name.lower().strip(), "cosine")


def best_first(metric: str, score: Column) -> Column:
    """Similarities are best when high, distances when low."""
    return score.asc() if metric == "euclid" else score.desc()


def _sum_of(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum_of(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null when either vector is all zeros."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclid(a: Column, b: Column) -> Column:
    def squared(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.sqrt(_sum_of(F.zip_with(a, b, squared)))


def expected_dimension(provider: Column, model: Column) -> Column:
    return F.when(
        (provider == "openai") & F.contains(F.lower(model), F.lit("large")), F.lit(3072)
    ).otherwise(F.lit(1536))


def get_embedding_dimension(provider: str, model: str) -> int:
    return 3072 if provider == "openai" and "large" in model.lower() else 1536
