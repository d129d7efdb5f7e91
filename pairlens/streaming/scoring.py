"""Scoring of findings as they arrive: a directory of Parquet files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import penalty
from ..operators.findings import PAIR, error_counts


def findings_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def penalties(stream: DataFrame) -> DataFrame:
    """Penalty of each finding: row by row, so without state or watermark."""
    return stream.withColumn("penalty", penalty())


def windowed_scores(stream: DataFrame, at: str, late: str = "30 days", width: str = "1 day") -> DataFrame:
    """Penalties per candidate and window of event time; rows later than ``late`` are dropped, and with them the state."""
    w = penalties(stream).withWatermark(at, late)
    return w.groupBy(F.window(at, width).alias("w"), "candidate_reporter").agg(F.sum("penalty").alias("penalty"), F.count("*").alias("n_findings")).select("w.start", "candidate_reporter", "penalty", "n_findings")


def score_batches(stream: DataFrame, sink: str, checkpoint: str, variant: str = "a") -> StreamingQuery:
    """Counts and scores of each micro-batch, one directory per batch: a batch that runs again overwrites its own result.

    A pair whose findings come in several batches has a row in each; all of them are sums, and ``scores_so_far`` adds them up.
    """

    def write(batch: DataFrame, number: int) -> None:
        error_counts(batch, variant).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scores_so_far(spark: SparkSession, sink: str) -> DataFrame:
    """Counts and scores of each pair over all batches written by now."""
    parts = spark.read.parquet(sink)
    return parts.groupBy(*PAIR).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in (*PAIR, "batch")])


def compact(spark: SparkSession, sink: str, to: str) -> None:
    """Writes ``scores_so_far`` to another folder, one row per pair."""
    scores_so_far(spark, sink).write.mode("overwrite").parquet(to)
