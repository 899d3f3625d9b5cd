"""Session settings and durable cut points."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Largest ordered group handled by one plain window task; larger groups are
# range partitioned (operators/ordering.py).
WINDOW_ROWS_KEY = "spark.stratafold.windowRows"
WINDOW_ROWS_DEFAULT = 2_000_000
# Largest lookup side that is broadcast after its rows were counted.
BROADCAST_ROWS_KEY = "spark.stratafold.broadcastRows"
BROADCAST_ROWS_DEFAULT = 100_000


def build_session(app: str = "stratafold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes.

    On a cluster leave ``master`` unset so that spark-submit decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def int_conf(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def shared_folder(spark: SparkSession) -> str:
    """This run's own folder in ``spark.checkpoint.dir``.

    A temporary folder is set only when neither the setting nor a directory
    exists (local tests).
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            shared = os.path.join(tempfile.mkdtemp(prefix="stratafold-"), "checkpoints")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage (``shared_folder``) and continue from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Shuffle rows over all cores once: the passes over them outweigh it, and their order is mixed."""
    spark = df.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(shuffles, spark.sparkContext.defaultParallelism))
