"""Findings, nested reports and snapshots per sample, and the sinks that persist them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low", "info")


def findings(sinks: DataFrame, indicators: DataFrame) -> DataFrame:
    """(sample_id, title, severity, evidence): one finding for each call and each type of indicator."""
    a = sinks.groupBy("sample_id", "api").agg(F.min("severity").alias("severity"), F.count("*").alias("n")).select("sample_id", F.concat(F.lit("Call: "), "api").alias("title"), "severity", F.col("n").cast("string").alias("evidence"))
    b = indicators.groupBy("sample_id", "type").agg(F.count("*").alias("n")).select("sample_id", F.concat(F.lit("Indicator: "), "type").alias("title"), F.lit("info").alias("severity"), F.col("n").cast("string").alias("evidence"))
    return a.unionByName(b)


def severity_rank(column):
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), column)


def overall(found: DataFrame) -> DataFrame:
    """The severity of a sample: critical from three high findings on, high from one, medium from one medium, else low."""
    n = found.groupBy("sample_id").agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))
    return n.select("sample_id", F.when(F.col("high") >= 3, "critical").when(F.col("high") >= 1, "high").when(F.col("medium") >= 1, "medium").otherwise("low").alias("overall"))


def json_report(found: DataFrame) -> DataFrame:
    """(sample_id, report): nested JSON, findings by severity and title."""
    rows = found.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(severity_rank(F.col("severity")).alias("rank"), "title", "severity", "evidence"))).alias("f"))
    items = F.transform("f", lambda x: F.struct(x["title"].alias("title"), x["severity"].alias("severity"), x["evidence"].alias("evidence")))
    return rows.select("sample_id", F.to_json(F.struct(F.size("f").alias("total"), items.alias("findings"))).alias("report"))


def markdown_report(found: DataFrame) -> DataFrame:
    rows = found.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(severity_rank(F.col("severity")).alias("rank"), "title", "severity", "evidence"))).alias("f"))
    lines = F.transform("f", lambda x: F.format_string("- **%s** (%s): %s", x["title"], x["severity"], x["evidence"]))
    return rows.select("sample_id", F.concat(F.lit("## Findings\n"), F.array_join(lines, "\n")).alias("report"))


def snapshot(samples: DataFrame, **children: DataFrame) -> DataFrame:
    """Each sample with the number of rows that each child table holds for it."""
    out = samples.select("sample_id")
    for name, rows in children.items():
        out = out.join(rows.groupBy("sample_id").agg(F.count("*").alias(f"n_{name}")), "sample_id", "left")
    return out.fillna(0)


#: Greatest lengths of what is stored.
LIMITS = {"value": 2000, "title": 500, "description": 5000, "evidence": 5000, "context": 500}


def persist(rows: DataFrame, path: str) -> None:
    """Write child rows with long columns cut, one folder per sample; samples that `rows` lacks keep theirs."""
    cut = {c: F.substring(c, 1, n) for c, n in LIMITS.items() if c in rows.columns}
    rows.withColumns(cut).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_id").parquet(path)
