"""Streams of documents: first occurrences of a text, and running token totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow_spark.functions.tokens import estimate_tokens
from winnow_spark.operators.dedupe import normalize_text


def first_texts(stream: DataFrame, time: str = "ts", text: str = "text", delay: str = "1 hour") -> DataFrame:
    """Rows whose normalised text was not met within ``delay``; state is bounded by the watermark."""
    keyed = stream.withColumn("text_key", F.sha2(normalize_text(F.col(text)), 256))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_key"])


def token_totals(stream: DataFrame, time: str = "ts", text: str = "text", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Documents and tokens by time window."""
    windowed = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("window"))
    return windowed.agg(F.count("*").alias("n_documents"), F.sum(estimate_tokens(F.col(text))).alias("tokens"))
