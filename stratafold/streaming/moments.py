"""Ensemble moments that grow as member files arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

MEMBER_SCHEMA = "member int, r bigint, c bigint, probability double"


def read_members(spark: SparkSession, folder: str, schema: str = MEMBER_SCHEMA, files_per_trigger: int | None = None, name: str | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive, or only those called ``name``."""
    reader = spark.readStream.schema(schema)
    if name:
        reader = reader.option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def running_moments(members: DataFrame, keys=("r", "c"), value: str = "probability") -> DataFrame:
    """The state per cell is a count, a mean and a squared-deviation sum, whatever the number of members."""
    return members.groupBy(*keys).agg(
        F.count(value).alias("members"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def start(moments: DataFrame, checkpoint: str, sink, mode: str = "update") -> StreamingQuery:
    """Run over what has arrived and stop. ``sink(batch, epoch)`` stores each batch; upserts by cell are idempotent."""
    return (
        moments.writeStream.outputMode(mode).foreachBatch(sink)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def versioned(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the whole table as one version per batch in shared storage: the version before, rows of the batch put in by key.

    A batch that runs again after a lost driver reads the version before it and writes its own anew, so the result is the
    same; nothing is held in memory. Batches are numbered from 0 without gaps by the query's checkpoint.
    """
    def store(batch: DataFrame, epoch: int) -> None:
        fresh = batch
        if epoch:
            before = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/version={epoch - 1}")
            named = fresh.select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
            fresh = before.join(named, same, "left_anti").unionByName(fresh)
        fresh.write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return store


def latest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The last version that a :func:`versioned` sink has written."""
    stored = spark.read.schema(StructType([*schema, StructField("version", LongType())])).parquet(path)
    number = stored.select(F.max("version")).first()[0]
    return stored.where(F.col("version") == number).drop("version")
