"""Corpus preparation in five stages, each over all that its predecessor kept.

Quality rules drop what they reject; of each class of near duplicates the least document stays; secrets are masked in the
texts; sources are mixed to their target weights, so documents are left out, repeated or cut to the words the mix takes;
what remains is packed into training windows. All stages but the last return the columns of ``documents``.

Edge cases: an empty table gives an empty result at every stage. NULL and empty texts fail the quality rules. A NULL id is an
id like others, the last in order. Extra columns are carried to the last stage; one named like an operator's result holds that
result from its stage on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratafold.llm import chosen_path, mixing, packing, quality_rules, secret_index
from stratafold.llm.repeats import text_keys
from stratafold.session import cut, shared_folder


BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Batches for Python workers hold at most so many bytes in this session, unless it already has a lower bound."""
    now = spark.conf.get(BATCH_BYTES_KEY)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most_bytes:
        spark.conf.set(BATCH_BYTES_KEY, str(most_bytes))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    bound_batches(spark)
    return quality_rules.apply_rules(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: the one with the least id, of rows with that id the one with the least text hash."""
    bound_batches(spark)
    found = chosen_path.near_duplicates(docs)
    order = Window.partitionBy("class_key").orderBy(F.col("doc_id").asc_nulls_last(), "k1", "k2")
    chosen = found.withColumn("place", F.row_number().over(order)).where("place = 1").select(F.col("doc_id").alias("_id"), "k1", "k2")
    picked = docs.withColumns(dict(zip(("k1", "k2"), text_keys("text")))).join(cut(chosen), ["k1", "k2"])
    picked = picked.where(F.col("doc_id").eqNullSafe(F.col("_id")))
    repeated = Window.partitionBy("k1", "k2", "_id").orderBy("k1")  # rows equal in id and text
    return picked.withColumn("_n", F.row_number().over(repeated)).where("_n = 1").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets masked and n_chars counted anew where that changed a text."""
    bound_batches(spark)
    masked = secret_index.redact(docs.withColumn("_before", F.xxhash64("text")))
    count = F.when(F.xxhash64("text") == F.col("_before"), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return masked.withColumn("n_chars", count).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix."""
    return mixing.realize(mixing.mix(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows with their token ids."""
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]
ORACLE_SQL = None  # tokens, divergences and chosen paths are not SQL; tests/llm holds it against plain code


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; every stage is written to the shared folder once and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        done = stage(spark, docs, sf_dir)
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
