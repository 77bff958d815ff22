"""Typed rows out of texts: indicators, string literals and dangerous calls, with their positions in code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text as T

SPANS = "array<struct<start:int,end:int,value:string>>"


def spans(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches of a pattern as (start, end, value of the group): gaps and matches add up to positions."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))

    def step(acc, m):
        start = acc["at"] + F.length(m["gap"])
        end = start + F.length(m["whole"])
        span = F.struct(start.alias("start"), end.alias("end"), m["part"].alias("value"))
        return F.struct(end.alias("at"), F.when(m["whole"].isNotNull(), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    start = F.coalesce(F.lit(None).cast(f"struct<at:int,spans:{SPANS}>"), F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans")))
    return F.when(text.rlike(pattern), F.aggregate(pieces, start, step)["spans"]).otherwise(F.array().cast(SPANS))


def indicators(samples: DataFrame) -> DataFrame:
    """(sample_id, type, value, original, defanged, start): the first occurrence of each type and value.

    A hash inside a longer hash is none of its own. Hashes are lower-cased and hold a letter; defanged ones are refanged.
    """
    t = F.col("text")

    def named(rank, kind, defanged, found, lower=False):
        def one(x):
            value = T.refang(x["value"]) if defanged else F.lower(x["value"]) if lower else x["value"]
            return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("type"), value.alias("value"), x["value"].alias("original"), F.lit(defanged).alias("defanged"), x["start"].alias("start"))

        return F.transform(found, one)

    kinds = [named(i, kind, defanged, spans(t, pattern)) for i, (kind, pattern, defanged) in enumerate(fixed.INDICATORS)]
    for i, (kind, digits) in enumerate(fixed.HASHES):
        # Word boundaries on both sides rule out a shorter hash inside a longer one.
        found = F.filter(spans(t, rf"\b([a-fA-F0-9]{{{digits}}})\b"), lambda s: s["value"].rlike("[a-fA-F]"))
        kinds.append(named(100 + i, kind, False, found, lower=True))
    rows = samples.select("sample_id", F.inline(F.concat(*kinds)))
    first = Window.partitionBy("sample_id", "type", "value").orderBy("rank", "start")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "rank")


def literals(samples: DataFrame) -> DataFrame:
    """(sample_id, start, end, raw, value, is_url, is_base64, is_path, is_long): quoted string literals in order."""
    rows = samples.select("sample_id", F.inline(spans(F.col("text"), r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')""")))
    value = F.expr("substring(value, 2, length(value) - 2)")
    return rows.select("sample_id", "start", "end", F.col("value").alias("raw"), value.alias("value")).select(
        "*", F.col("value").rlike("(?i)https?://").alias("is_url"), F.col("value").rlike("^[A-Za-z0-9+/]{16,}={0,2}$").alias("is_base64"), F.col("value").rlike(r"^/\w+(?:/[\w.-]+)+").alias("is_path"), (F.length("value") > 50).alias("is_long")
    )


def sinks(samples: DataFrame) -> DataFrame:
    """(sample_id, api, severity, argument, position, rank): dangerous calls of the sample's language, ranked high to low, then by kind and
    position. A sample of another language, or of none, is searched for the calls of all; a call that two of them name alike counts once."""

    def named(kind, api, severity):
        return lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(api).alias("api"), F.lit(severity).alias("severity"), F.substring(F.trim(x["value"]), 1, 500).alias("argument"), x["start"].alias("position"))

    language, known = F.col("language"), list(fixed.SINKS)
    kinds, seen = [], set()
    for lang, table in fixed.SINKS.items():
        for api, severity, pattern in table:
            # The first language of a name finds it for samples of unknown language.
            own = (language == lang) if api in seen else (language == lang) | ~F.coalesce(language.isin(known), F.lit(False))
            seen.add(api)
            none = F.array().cast("array<struct<kind:int,api:string,severity:string,argument:string,position:int>>")
            kinds.append(F.when(own, F.transform(spans(F.col("text"), pattern), named(len(kinds), api, severity))).otherwise(none))
    rows = samples.select("sample_id", F.inline(F.concat(*kinds)))
    order = Window.partitionBy("sample_id").orderBy(F.array_position(F.array(*map(F.lit, ("high", "medium", "low"))), F.col("severity")), "kind", "position")
    return rows.withColumn("rank", F.row_number().over(order)).drop("kind")
