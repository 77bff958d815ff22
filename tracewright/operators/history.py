"""Operators over the iterations of an analysis: latest state, changes, plateaus, failure streaks, queues and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_sample(*order):
    return Window.partitionBy("sample_id").orderBy(*order)


def latest(history: DataFrame) -> DataFrame:
    """The last iteration of each sample."""
    return history.withColumn("n", F.row_number().over(by_sample(F.desc("iteration")))).where("n = 1").drop("n")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; where both have a (sample_id, iteration), the new one."""
    both = old.withColumn("age", F.lit(1)).unionByName(new.withColumn("age", F.lit(0)))
    w = Window.partitionBy("sample_id", "iteration").orderBy("age")
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "age")


def changes(history: DataFrame) -> DataFrame:
    """Each iteration with the score before it and the difference."""
    before = F.lag("score").over(by_sample("iteration"))
    return history.select("sample_id", "iteration", before.alias("before"), F.col("score").alias("after"), (F.col("score") - before).alias("change"))


def plateaus(history: DataFrame, steps: int = 3, least: float = 0.02) -> DataFrame:
    """Whether the last `steps` differences of the score are all below `least`."""
    diffs = changes(history).withColumn("size", F.abs("change"))
    w = by_sample("iteration").rowsBetween(-(steps - 1), 0)
    return diffs.select("sample_id", "iteration", ((F.count("size").over(w) == steps) & (F.max("size").over(w) < least)).alias("plateau"))


def failure_streaks(history: DataFrame) -> DataFrame:
    """The number of failures at the end of each sample's history."""
    last_success = history.where("success").groupBy("sample_id").agg(F.max("iteration").alias("last"))
    both = history.join(last_success, "sample_id", "left")
    return both.groupBy("sample_id").agg(F.count_if(F.col("last").isNull() | (F.col("iteration") > F.col("last"))).alias("streak"))


def outcome_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("sample_id").agg(F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.count("*").alias("iterations"))


def repeated_failures(history: DataFrame, least: int = 2) -> DataFrame:
    return history.where("not success").groupBy("sample_id", "action").agg(F.count("*").alias("failures")).where(F.col("failures") >= least)


def next_actions(queue: DataFrame) -> DataFrame:
    """The pending action of each sample with the least (priority, seq); a missing priority is (1 - confidence) - 0.5 if
    deterministic."""
    given = F.coalesce("priority", (1 - F.col("confidence")) - F.when(F.col("deterministic"), 0.5).otherwise(0.0))
    ranked = queue.where("status = 'PENDING'").withColumn("priority", given)
    return ranked.withColumn("n", F.row_number().over(by_sample("priority", "seq"))).where("n = 1").drop("n")


def updated_confidence(confidence, success, improvement, own, sinks):
    """Confidence after an action: a failure costs 0.02; a success adds 0.3 of its improvement, 0.1 of its own confidence and
    up to 0.08 for removed sinks; clamped to 0..1."""
    bonus = F.least(F.lit(0.08), sinks * 0.02)
    return F.when(~success, F.greatest(confidence - 0.02, F.lit(0.0))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence + 0.3 * improvement + 0.1 * own + bonus)))
