"""Document fingerprints: threshold-scaled sketches.

A sketch retains every shingle hash below a fixed fraction of the hash range, so it grows with its text, and the sketch of
two texts together is the union of theirs. Containment between texts of very unequal sizes is the share of the smaller
sketch's hashes that the other one has. A fingerprint is the sketch after a hash of the whole text, which tells texts apart
whose shingles are too few to leave any.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import common
from .textnum import BYTE_CODE, U, mix, powers

GRAM = 12  # bytes in a shingle; a shorter text is one shingle
SCALE = 16  # one of so many hashes is retained
LIMIT = (1 << 32) // SCALE
SAMPLE = 200


def sketch(data: bytes) -> np.ndarray:
    """The sorted 32-bit hashes that are retained."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint32)
    width = min(GRAM, len(b))
    up, down = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, U)
    np.cumsum(BYTE_CODE[b] * up[:-1], out=total[1:])
    n = len(b) - width + 1
    h = (mix((total[width:] - total[:n]) * down[:n] + U(width)) >> U(32)).astype(np.uint32)
    return np.unique(h[h < LIMIT])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts together."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smaller sketch in the other one; 0 if one is empty."""
    return len(np.intersect1d(a, b, assume_unique=True)) / max(1, min(len(a), len(b)))


def whole(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:16]


def code(data: bytes, s: np.ndarray) -> str:
    return whole(data) + s.astype(">u4").tobytes().hex()


def likeness(x: bytes, a: np.ndarray, y: bytes, b: np.ndarray) -> float:
    """Of two fingerprints: 1 if they are of one text, else the containment of their sketches."""
    return 1.0 if x == y else containment(a, b)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Partitions of about equal bytes by descending doc_id, sorted; `heir` rows repeat the first row of the next partition's
    range at the end, so that every row meets the one that follows it. The texts are shuffled once.

    Columns: part (int), heir (boolean), k, h, doc_id, text. Rows of one doc_id, or of none, are ordered and dealt by a hash of
    their text, so only equal rows must stay together. The last row's successor is the first row of all.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    partitions = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Cuts come from about SAMPLE keys a partition, weighted by their bytes.
    share = min(1.0, SAMPLE * partitions / max(1, docs.count()))
    some = keyed.where(F.xxhash64("k", "h").bitwiseAND(0xFFFFFF) < share * (1 << 24)).groupBy("k", "h").agg(F.sum(F.octet_length("text") + F.lit(64)).alias("b"))
    rows = sorted((r.k, r.h, r.b) for r in some.collect())
    weight = np.cumsum([r[2] for r in rows])
    cuts = sorted({rows[int(np.searchsorted(weight, weight[-1] * i / partitions))][:2] for i in range(1, partitions)}) if rows else []
    cut = np.array(cuts, np.int64).reshape(-1, 2).view([("k", np.int64), ("h", np.int64)]).reshape(-1)

    @pandas_udf("int")
    def part_of(k: pd.Series, h: pd.Series) -> pd.Series:
        row = np.zeros(len(k), cut.dtype)
        row["k"], row["h"] = k, h
        both = np.r_[cut, row]
        order = np.lexsort((np.arange(len(both)), both["h"], both["k"]))  # a cut comes before the rows equal to it
        passed = np.empty(len(both), np.int32)
        passed[order] = np.cumsum(order < len(cut))
        return pd.Series(passed[len(cut) :])

    tops = keyed.select(part_of("k", "h").alias("part"), F.struct("k", "h").alias("top")).groupBy("part").agg(F.min("top").alias("top")).collect()  # a row per partition
    tops = sorted((r.part, r.top.k, r.top.h) for r in tops)
    firsts = spark.createDataFrame([(k, h, tops[i - 1][0]) for i, (_, k, h) in enumerate(tops)] or [(0, 0, -1)], "k long, h long, goes int")  # the first row of all also follows the last
    dealt = keyed.join(F.broadcast(firsts), ["k", "h"], "left")
    own = F.struct(part_of("k", "h").alias("part"), F.lit(False).alias("heir"))
    copy = F.struct(F.col("goes").alias("part"), F.lit(True).alias("heir"))
    dealt = dealt.select("k", "h", "doc_id", "text", F.explode(F.when(F.col("goes").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("x"))
    dealt = dealt.select("x.part", "x.heir", "k", "h", "doc_id", "text")
    return dealt.repartition(partitions, "part").sortWithinPartitions("part", "heir", "k", "h")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Null texts are empty. Rows with equal doc_id follow each other by a hash of their text; null doc_ids come last. A single row follows
    itself. Other columns are ignored. Fingerprints are hexadecimal: a hash of the text, then the sorted hashes of its sketch.
    Likeness is 1 for equal texts; of unequal texts, too short for one to leave a hash, it is 0.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))

    def run(batches):
        held = None
        for batch in batches:
            out = []
            for part, heir, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5)), strict=True):
                data = text.encode()
                mine = sketch(data)
                if held and held[0] == part:
                    raw = edited(held[2], text).encode()
                    old, new = held[2].encode(), sketch(raw)
                    out.append((held[1], len(held[2]), hashlib.sha256(raw).hexdigest(), code(old, held[3]), code(raw, new), likeness(old, held[3], raw, new), likeness(old, held[3], data, mine)))
                held = None if heir else (part, doc_id, text, mine)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)


def op6_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprint(common.table(spark, sf_dir, "documents"))
