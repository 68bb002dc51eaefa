"""Sentences as a stream: the same expressions as for tables, and running statistics with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conditions import Cond, tokens_where
from ..sources.conllu import BLANK, TOKEN_LINE, parse


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of CoNLL-U files as they arrive in a folder, with LF or CRLF line ends."""
    rows = spark.readStream.text(folder, lineSep="\n\n").select(F.explode(F.split("value", BLANK)).alias("value"))
    return parse(rows.where(F.col("value").rlike(TOKEN_LINE)))


def matches(stream: DataFrame, c: Cond, *keys: str) -> DataFrame:
    """Tokens that satisfy a condition; stateless, so append mode works."""
    return tokens_where(stream, c, *keys)


def running_counts(stream: DataFrame, field: str = "upos") -> DataFrame:
    """Frequencies so far; for complete or update mode."""
    return stream.select(F.explode(F.transform("words", lambda w: w[field])).alias(field)).groupBy(field).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str, key: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts by event-time window and key; what arrives later than the watermark allows is left out."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
