"""Token cost reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: US dollars per million embedding tokens of the small model.
EMBED_PRICE_PER_MILLION = 0.020


def token_cost(
    usage: DataFrame,
    ts: str,
    model: str,
    tokens: Column,
    price_per_million: float = EMBED_PRICE_PER_MILLION,
) -> DataFrame:
    """Calls, tokens and cost per month and model."""
    return (
        usage.groupBy(F.date_format(ts, "yyyy-MM").alias("month"), F.col(model).alias("model"))
        .agg(F.count("*").alias("calls"), F.sum(tokens.cast("long")).alias("tokens"))
        .withColumn("cost", F.col("tokens") * F.lit(price_per_million) / F.lit(1e6))
    )
