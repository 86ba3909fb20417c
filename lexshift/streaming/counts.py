"""Additive operators over files that arrive in pieces, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexshift.operators import index as I


def stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """Parquet files of one schema as they arrive in a folder."""
    return spark.readStream.schema(like.schema).parquet(folder)


def running_counts(docs: DataFrame) -> DataFrame:
    """``term, n`` of a stream of ``id, corpus, tokens``; use output mode complete or update."""
    return I.term_counts(I.positions(docs))


def distinct_mentions(subs: DataFrame, delay: str = "60 days") -> DataFrame:
    """A stream of substitutes without repeated mentions; keys are forgotten after ``delay`` of ``written_at``."""
    return subs.withWatermark("written_at", delay).dropDuplicatesWithinWatermark(["term", "line_id", "token_index"])


def windowed_mentions(subs: DataFrame, width: str = "10 minutes", delay: str = "60 days") -> DataFrame:
    """``start, term, n``: mentions by the window in which they were written."""
    return subs.withWatermark("written_at", delay).groupBy(F.window("written_at", width), "term").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "term", "n")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All files there are now, then stop; a later call goes on from there."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
