"""Question history as text lines ``timestamp|tokens|question``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.text import preview, stamp, strip


def history_line(ts: Column, tokens: Column, question: Column) -> Column:
    return F.concat_ws("|", stamp(ts), F.coalesce(tokens, F.lit(0)).cast("string"), question)


def append_history(answers: DataFrame, path: str) -> None:
    """Append ``(ts, tokens, question)`` rows to a text history."""
    line = history_line(F.col("ts"), F.col("tokens"), F.col("question"))
    answers.select(line.alias("value")).write.mode("append").text(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return parse_history(spark.read.text(path), "value")


def parse_history(lines: DataFrame, column: str) -> DataFrame:
    """``(timestamp, tokens, question)``; short lines are dropped.

    Only the first two bars separate, later ones belong to the question. Tokens
    that are not all digits count as 0; a number beyond 64 bits is unknown (null).
    """
    parts = F.split(strip(F.col(column)), r"\|", 3)
    rest = [c for c in lines.columns if c != column]
    return (
        lines.withColumn("_parts", parts)
        .where(F.size("_parts") == 3)
        .select(
            *rest,
            F.col("_parts")[0].alias("timestamp"),
            F.when(F.rlike(F.col("_parts")[1], F.lit("^[0-9]+$")), F.col("_parts")[1].try_cast("bigint"))
            .otherwise(F.lit(0).cast("bigint"))
            .alias("tokens"),
            F.col("_parts")[2].alias("question"),
        )
    )


def recent_questions(history: DataFrame, by: list[str], order: list[Column], n: int = 10) -> DataFrame:
    """The newest ``n`` entries of each user, numbered from the newest, with a preview."""
    newest = Window.partitionBy(*by).orderBy(*order)
    return (
        history.withColumn("place", F.row_number().over(newest))
        .where(F.col("place") <= n)
        .withColumn("shown", preview(F.col("question"), 60))
    )
