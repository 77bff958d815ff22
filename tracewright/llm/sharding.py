"""Sharding: a uniform shuffle with exact shard sizes by a hypergeometric communication matrix.

Source partitions send exact numbers of rows to the shards: the matrix of these numbers is drawn from the multivariate
hypergeometric law that a uniform shuffle of all rows would give. Each source permutes its rows locally and deals them by
its row of the matrix; each shard permutes what it got.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SOURCES = 1 << 16  # at most; more input partitions share sources, so the matrix has a fixed bound
SUB_ROWS = 200_000  # rows of a sub-bucket of a shard, which one task sorts


def _stirling(n: float) -> float:
    """What Stirling's formula leaves of log n!."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: float, m: float) -> float:
    """x log(x / m) + m - x, without cancellation near m."""
    if not x:
        return m
    d = (x - m) / m
    if abs(d) > 0.1:
        return x * math.log(x / m) + m - x
    # (1 + d) log(1 + d) - d as a series in d
    return m * sum((-d) ** k / (k * (k - 1)) for k in range(2, 22))


def _log_binomial(x: int, n: int, p: float) -> float:
    if x in (0, n):
        return n * (math.log1p(-p) if x == 0 else math.log(p))
    return _stirling(n) - _stirling(x) - _stirling(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def log_share(x: int, good: int, bad: int, n: int) -> float:
    """Log of the hypergeometric probability of x, up to a constant, by the saddle-point form, which keeps its precision at any size."""
    p = n / (good + bad)
    return _log_binomial(x, good, p) + _log_binomial(n - x, bad, p)


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn without replacement are good. Beyond the range of numpy's sampler the same law is drawn by
    rejection under a ratio of uniforms."""
    if not n or not good:
        return 0
    if not bad or n == good + bad:
        return n if not bad else good
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean = n * (good / total)
    spread = math.sqrt(mean * (bad / total) * ((total - n) / (total - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    low, high = max(0, n - bad), min(good, n)
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    top = log_share(mode, good, bad, n)
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= x <= high and 2 * math.log(u) <= log_share(x, good, bad, n) - top:
            return x


def matrix(sizes: list[int], capacity: list[int], seed: int) -> np.ndarray:
    """Counts sources x shards with row sums `sizes` and column sums `capacity`, drawn exactly."""
    rng = np.random.default_rng(seed)
    left = list(capacity)
    out = np.zeros((len(sizes), len(capacity)), np.int64)
    for i, n in enumerate(sizes):
        rest = sum(left)
        for j in range(len(left)):
            rest -= left[j]
            out[i, j] = _draw(rng, left[j], rest, n) if rest else n
            n -= int(out[i, j])
            left[j] -= int(out[i, j])
    return out


def shuffle(rows: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """Every row with `shard` (counts at most one apart) and `slot` (gapless from 0 in its shard) added.

    Equal, repeated and null rows are rows like any other. An empty table gives an empty result. Columns of `rows` named shard or slot are
    replaced; names that begin with `_tw_` are reserved. The rows are written once to the shared folder, so that a lost executor changes nothing.
    """
    rows = rows.drop("shard", "slot")
    names = rows.columns
    placed = rows.withColumn("_tw_row", F.monotonically_increasing_id()).withColumn("_tw_src", F.pmod(F.spark_partition_id(), F.lit(SOURCES)))
    placed = common.materialize(placed)
    spark = rows.sparkSession
    sizes = {r["_tw_src"]: r["count"] for r in placed.groupBy("_tw_src").count().collect()}  # SOURCES rows at most
    total = sum(sizes.values())
    sources = sorted(sizes)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    counts = matrix([sizes[s] for s in sources], capacity, seed)
    # The matrix joins on the key that the local permutation is dealt by, so the rows are not shuffled for it.
    deal = spark.createDataFrame([(s, [int(x) for x in np.cumsum(c)]) for s, c in zip(sources, counts, strict=True)], "_tw_src int, _tw_cum array<long>")
    local = Window.partitionBy("_tw_src").orderBy(F.xxhash64("_tw_row", F.lit(seed)), "_tw_row")
    sent = placed.withColumn("_tw_rank", F.row_number().over(local) - 1).join(deal, "_tw_src")
    sent = sent.withColumn("shard", F.size(F.filter("_tw_cum", lambda c: c <= F.col("_tw_rank")))).drop("_tw_cum", "_tw_rank")
    subs = max(8, -(-total // (shards * SUB_ROWS)))
    key = F.xxhash64("_tw_row", F.lit(seed + 1))
    sent = sent.withColumn("_tw_key", key).withColumn("_tw_sub", F.floor((F.shiftrightunsigned(F.col("_tw_key"), 33) * F.lit(subs)) / F.lit(float(1 << 31))).cast("int"))
    sent = common.materialize(sent)
    sub = sent.groupBy("shard", "_tw_sub").count()  # a row for SUB_ROWS input rows
    before = Window.partitionBy("shard").orderBy("_tw_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = sub.select("shard", "_tw_sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_tw_start"))
    inner = Window.partitionBy("shard", "_tw_sub").orderBy("_tw_key", "_tw_row")
    out = sent.withColumn("_tw_at", F.row_number().over(inner) - 1).join(starts, ["shard", "_tw_sub"])
    return out.select(*names, "shard", (F.col("_tw_start") + F.col("_tw_at")).alias("slot"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
