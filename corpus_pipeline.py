"""A corpus pipeline of five stages. Each takes what its predecessor kept; the last one packs it.

Toxic documents go; one document of each group of near-duplicates stays; documents that hold benchmark items go; secrets
are replaced in the text; what is left is packed into windows. All but the last return the columns of `documents`.
Rows with the same doc_id and text are one document; rows with null ids are told apart by their texts. Null and empty texts
are documents like any other. Other columns than those of documents are dropped.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import common, decontaminate, neardup, packing, secrets, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MASK = "[secret]"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that score below 0.5."""
    docs = docs.select(*COLUMNS)
    shared = spark.sparkContext.broadcast(toxicity.fit(docs, common.table(spark, sf_dir, "labels")))

    def make():
        model = shared.value
        return lambda rows, data, at: rows.filter(pc.less(pa.array(model.predict(data, at)), 0.5))

    return common.map_blocks(docs, docs.schema.simpleString()[7:-1], make)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` that have no equal (doc_id, tx) in `gone`; tx is the hash of the text."""
    tx = F.xxhash64(F.coalesce("text", F.lit("")))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("tx").alias("_of")).distinct()
    hashed = docs.select(*COLUMNS, tx.alias("_tx"))
    return hashed.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tx") == F.col("_of")), "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each group of documents linked at a similarity of 0.8 or more."""
    return without(docs, neardup.classified(docs, 80, 100).where("not kept"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that align with no benchmark item."""
    return without(docs, decontaminate.find(docs, common.table(spark, sf_dir, "benchmark")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every reported span; all documents stay, and n_chars follows the text."""
    tx = F.xxhash64(F.coalesce("text", F.lit("")))
    hashed = docs.select(*COLUMNS, tx.alias("_tx"))
    found = secrets.scan(hashed, ("_tx",)).where("size(spans) > 0").select(F.col("doc_id").alias("_id"), F.col("_tx").alias("_of"), "spans").dropDuplicates(["_id", "_of"])
    found = common.materialize(found)
    both = hashed.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tx") == F.col("_of")), "left")

    def step(acc, s):
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(F.concat(acc["out"], gap, F.lit(MASK)).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))

    done = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(done)
    n = F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return both.select("doc_id", text.alias("text"), "lang", "source", n.alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens: the pieces' places and checksums of their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), digest=True)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("secrets", without_secrets), ("packing", packed)]
#: None: the classifier and the packing order can't be expressed in SQL; tests compare each stage with its operator or brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialize(docs)
            common.release(spark)
    return docs
