"""Reading, scratch tables and bounded samples shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch and UTF-8 bytes of one numpy block. A longer text is a block of its own.
BATCH_ROWS = 512
BLOCK_BYTES = 1 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: once per application, as a zip that Spark distributes."""
    sc = spark.sparkContext
    if getattr(sc, "_tracewright_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="tracewright-")) / "tracewright_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc._tracewright_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where none is set, one of this machine's, if all of Spark runs on it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_scratch: list[str] = []


def clean(spark: SparkSession) -> None:
    """Delete the scratch tables of this application. Call it when no result of an operator is needed any more."""
    jvm = spark.sparkContext._jvm
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        clean(spark)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, so lost executors cost no recomputation."""
    spark = df.sparkSession
    ship(spark)
    path = f"{scratch_dir(spark)}/tw-{uuid.uuid4().hex}"
    _scratch.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage. Where lineage is cut again and again, plans, compiled classes, broadcasts and shuffles of the
    tables cut off would else fill the driver's whole heap before they go."""
    spark.sparkContext._jvm.System.gc()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets (one more than texts); null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into slices of whole rows with about `limit` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


def map_blocks(df: DataFrame, schema: str, make: Callable[[], Callable], text: str = "text") -> DataFrame:
    """mapInArrow over blocks: make() runs once per task and returns f(rows, data, offsets) -> dict of columns."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        f = make()
        for rows, data, at in blocks(batches, text):
            out = f(rows, data, at)
            yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def sample_order() -> Column:
    """A number from 0 to 1 that a document's id decides: samples are taken in its order, so they are the same on every run."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")).bitwiseAND(0xFFFFFFFF) / float(1 << 32)


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int, modulus: int = 5, held: int = 0) -> list:
    """At most `max_rows` whole labelled training texts of together at most `max_bytes`: (text, label) pairs.

    Rows with crc32(doc_id as text) mod `modulus` equal to `held` are never read. Of several labels of a document the least
    counts, of several texts the one of the least hash.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % modulus != held).groupBy("doc_id").agg(F.min("y").alias("y"))
    total = known.count()
    if not total:
        return []
    # Of about max_rows rows, whatever the number of labels, so it may be broadcast.
    known = known.where(sample_order() < min(1.0, (max_rows + 6 * max_rows**0.5 + 10) / total))
    return chosen(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id"), max_rows, max_bytes)


def chosen(rows: DataFrame, max_rows: int, max_bytes: int) -> list:
    """(text, y) of rows (doc_id, text, y) in the order of sample_order(): one text per document, `max_rows` texts and `max_bytes`
    together at most. Ids, hashes and sizes are sorted first, so only chosen texts reach the driver, each once."""
    text = F.xxhash64("text").alias("h")
    sizes = rows.groupBy("doc_id").agg(F.min(F.struct(text, F.octet_length("text").alias("b"), "y")).alias("x"))
    ids, used = [], 0
    for r in sizes.orderBy(sample_order(), "doc_id").limit(max_rows).collect():
        if used + r.x.b <= max_bytes:
            ids.append((r.doc_id, r.x.h, r.x.y))
            used += r.x.b
    if not ids:
        return []
    kind = rows.schema["y"].dataType.simpleString()
    want = rows.sparkSession.createDataFrame(ids, f"doc_id long, h long, y {kind}")  # max_rows rows
    got = rows.select("doc_id", "text", text).join(F.broadcast(want), ["doc_id", "h"]).dropDuplicates(["doc_id"])
    return [(r.text, r.y) for r in sorted(got.select("doc_id", "text", "y").collect(), key=lambda r: r.doc_id)]
