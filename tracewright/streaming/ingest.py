"""Continuous ingestion of samples: a file source through the same columns as batch runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def stream_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def annotated(samples: DataFrame) -> DataFrame:
    """One projection; works on batch and streaming frames alike."""
    return samples.select("sample_id", F.round(T.readability(F.col("text")), 6).alias("readability"), T.detect_language(F.col("text"))["language"].alias("language"))


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and type; rows later than the watermark are dropped by the engine."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")


def changed_only(statuses: DataFrame) -> DataFrame:
    """Batch frames: the rows whose payload differs from the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("sample_id").orderBy("at")
    return statuses.withColumn("before", F.lag("payload").over(w)).where(~F.col("payload").eqNullSafe(F.col("before"))).drop("before")
