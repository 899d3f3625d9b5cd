"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
#: On UTF-8 bytes ``bytes.split()`` cuts at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str = "text") -> Column:
    """The UTF-8 bytes of a text, none for NULL."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def arrow_batches(rows: Mapping[str, list | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [rows[f.name] if isinstance(rows[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(rows[f.name], f.type) for f in schema],
        schema=schema)


def blobs(column: pa.Array) -> Iterator[bytes]:
    """Each value of a binary column, NULL as no bytes."""
    return (v.as_py() or b"" for v in column)


def encoded(column: pa.Array) -> list[bytes]:
    """Each text of a string column in UTF-8, NULL as no bytes."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def blocks(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in a string or binary column hold about ``most_bytes``, one row at least."""
    sizes = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()]
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ddl(columns: Iterable[tuple[str, str]]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in columns)


def broadcast_if_small(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """``df`` marked for broadcast if the bytes of its rows, summed first, are few; else left to the optimizer."""
    size = df.select(F.octet_length(F.to_json(F.struct(*df.columns))).alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most_bytes else df
