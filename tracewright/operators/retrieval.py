"""Keyword retrieval over files and excerpts round the hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def scored(files: DataFrame, paths: list[str], keywords: list[str]) -> DataFrame:
    """(sample_id, path, score): a path term counts 40 if equal, 26 at the end, 18 inside, 12 as a base name; a keyword 6 in the
    path and 3 for each of up to four occurrences in the text. The stated terms are expressions, not a join."""
    path, text = F.lower("path"), F.lower("text")
    base = F.element_at(F.split(path, "/"), -1)
    terms = [F.when(path == p, 40.0).when(path.endswith(p), 26.0).when(path.contains(p), 18.0).when(base == p.rsplit("/", 1)[-1], 12.0).otherwise(0.0) for p in map(str.lower, paths)]
    for k in map(str.lower, keywords):
        hits = (F.length(text) - F.length(F.replace(text, F.lit(k)))) / len(k)
        terms.append(F.when(path.contains(k), 6.0).otherwise(0.0) + F.least(hits, F.lit(4)) * 3.0)
    return files.select("sample_id", "path", reduce(lambda a, b: a + b, terms).alias("score"))


def top(scores: DataFrame, k: int = 4) -> DataFrame:
    return scores.where("score > 0").orderBy(F.desc("score"), "path").limit(k)


def excerpts(files: DataFrame, keyword: str, before: int = 2, after: int = 3, most: int = 3) -> DataFrame:
    """(sample_id, block, first, last): windows of lines round the hits, merged where they meet; the first `most` of a text."""
    rows = files.select("sample_id", F.posexplode(T.lines(F.col("text"))).alias("at", "line"), F.size(T.lines(F.col("text"))).alias("n")).where(F.lower("line").contains(keyword.lower()))
    spans = rows.select("sample_id", F.greatest(F.col("at") - before, F.lit(0)).alias("a"), F.least(F.col("at") + after, F.col("n") - 1).alias("b"))
    w = Window.partitionBy("sample_id").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", (reach.isNull() | (F.col("a") > reach + 1)).cast("int")).withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where(F.col("block") <= most).groupBy("sample_id", F.col("block").cast("int").alias("block")).agg(F.min("a").alias("first"), F.max("b").alias("last"))


def search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows in which any of the columns holds the needle, whatever the case."""
    return rows.where(reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(needle.lower()) for c in columns]))
