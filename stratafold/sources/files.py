"""File-level tables: hashes, archive comparison, inventories and safe writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_table(files: DataFrame, content: str = "content") -> DataFrame:
    return files.select("path", F.octet_length(content).cast("bigint").alias("bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder, hashed on the executors.

    Spark's scan passes over empty files; their paths come from the file system's listing.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    none = spark.createDataFrame([(p,) for p in empty_files(spark, path)], "path string").withColumn("content", F.lit(b""))
    return hash_table(raw.select("path", "content").unionByName(none))


def empty_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the files without content below a folder, hidden ones left out as Spark leaves them out."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, listed = [], system.listFiles(root, True)
    while listed.hasNext():
        item = listed.next()
        name = item.getPath().getName()
        if item.getLen() == 0 and not name.startswith(("_", ".")):
            found.append(item.getPath().toString())
    return found


def dataset_hashes(hashes: DataFrame) -> DataFrame:
    """(stem, files): sidecar files of one dataset share a stem; one (suffix, hash) entry each."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stem, suffix = F.regexp_replace(name, r"\.[^.]+$", ""), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    folder = F.regexp_replace("path", r"/[^/]+$", "")
    return hashes.groupBy(folder.alias("folder"), stem.alias("stem")).agg(
        F.array_sort(F.collect_list(F.struct(suffix.alias("suffix"), "sha256"))).alias("files"))


def archive_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of files added, removed or altered between two hash tables."""
    a = before.select("path", F.col("sha256").alias("old"), F.lit(True).alias("was"))
    b = after.select("path", F.col("sha256").alias("new"), F.lit(True).alias("now"))
    joined = a.join(b, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return joined.select("path", change.alias("change"))


def inventory(expected: DataFrame, present: DataFrame, keys: Sequence[str], file: str = "file") -> DataFrame:
    """(keys, expected, missing): ';'-joined missing files per run (a run has a fixed short file list)."""
    keys = list(keys)
    seen = present.select(*keys, file).distinct().withColumn("_here", F.lit(1))
    joined = expected.join(seen, [*keys, file], "left")
    lost = F.array_sort(F.collect_list(F.when(F.col("_here").isNull(), F.col(file))))
    return joined.groupBy(*keys).agg(F.count("*").alias("expected"), F.array_join(lost, ";").alias("missing"))


def write_new(frame: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Refuse to touch an existing target."""
    frame.write.mode("errorifexists").format(fmt).options(**options).save(path)


def write_owned(frame: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions present in ``frame``; all others stay."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_table(frame: DataFrame, path: str) -> None:
    """CSV with header; an existing target is an error."""
    frame.write.mode("errorifexists").option("header", True).csv(path)


def manifest(parts: Mapping[str, Column | DataFrame], spark: SparkSession) -> DataFrame:
    """One JSON document from literals and one-row tables."""
    frame = spark.range(1).select(F.lit(0).alias("_one"))
    fields = []
    for name, part in parts.items():
        if isinstance(part, DataFrame):
            one = part.select(F.struct("*").alias(name))
            frame = frame.join(F.broadcast(one))  # one row
            fields.append(F.col(name))
        else:
            fields.append(part.alias(name))
    return frame.select(F.to_json(F.struct(*fields)).alias("manifest"))
