"""Train/validation/test splits: by block, by hash within label, by searched holdout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions.keys import order_key
from stratafold.operators.ordering import prefix_totals, small_side


def assign_partitions(df: DataFrame, blocks: DataFrame, block: str = "block_id") -> DataFrame:
    """Join (block, partition) onto rows; unassigned blocks give a NULL partition."""
    return df.join(small_side(blocks.select(block, "partition")), block, "left")


def split_problems(assigned: DataFrame, blocks: DataFrame, label: str = "label", block: str = "block_id") -> DataFrame:
    """(problem, detail): blocks in two partitions, rows without partition, partitions without both classes."""
    twice = blocks.groupBy(block).agg(F.countDistinct("partition").alias("n")).where("n > 1").select(
        F.lit("block in several partitions").alias("problem"), F.col(block).cast("string").alias("detail"))
    lost = assigned.where(F.col("partition").isNull()).groupBy(block).count().select(
        F.lit("block without partition").alias("problem"), F.col(block).cast("string").alias("detail"))
    one = assigned.where(F.col("partition").isNotNull()).groupBy("partition").agg(
        F.countDistinct(label).alias("n")).where("n < 2").select(
        F.lit("partition with one class").alias("problem"), F.col("partition").alias("detail"))
    return twice.unionByName(lost).unionByName(one)


def split_counts(assigned: DataFrame, label: str = "label", block: str = "block_id") -> DataFrame:
    """Rows, positives and the populated blocks of each partition."""
    # Blocks are few (grid squared); rows are folded to blocks before any list is built.
    folded = assigned.groupBy("partition", block).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    return folded.groupBy("partition").agg(
        F.sum("n").alias("rows"), F.sum("pos").alias("positives"), F.array_sort(F.collect_list(block)).alias("blocks"))


def partition_isolation(assigned: DataFrame, block: str = "block_id") -> DataFrame:
    return assigned.groupBy(block).agg(F.countDistinct("partition").alias("partitions"), F.count("*").alias("rows"))


def stratified_split(
    df: DataFrame, label: str, row_id: str, fractions: Mapping[str, float], seed: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Random split that keeps label shares: the first fraction of each label in hash order, and so on."""
    keyed = df.withColumn("_key", order_key(seed, "split", F.col(row_id)))
    placed = prefix_totals(
        keyed, [*keys, label], [F.col("_key").asc(), F.col(row_id).asc()],
        totals={"_n": F.lit(1).cast("bigint")}, position="_at",
    )
    names = list(fractions)
    edge, choice = 0.0, None
    for name in names[:-1]:
        edge += fractions[name]
        test = F.col("_at") <= F.bround(F.col("_n") * F.lit(edge), 0)
        choice = F.when(test, name) if choice is None else choice.when(test, name)
    return placed.withColumn("partition", choice.otherwise(names[-1])).drop("_key", "_n", "_at")


def grouped_holdout(
    df: DataFrame, label: str, block: str, fraction: float, seed: int, trials: int = 256
) -> DataFrame:
    """(trial, score, blocks): the first best of ``trials`` random block subsets.

    A trial holds ceil(fraction * blocks) blocks. It counts only if both
    classes occur on both sides; its score is the relative miss in rows plus
    the relative miss in positives. Rows are folded to blocks first, so all
    trials run over a table of blocks.
    """
    folded = df.groupBy(F.col(block).alias("block_id")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    tried = folded.select("*", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    key = order_key(seed, "holdout", F.col("trial"), F.col("block_id"))
    placed = prefix_totals(
        tried.withColumn("_key", key), ["trial"], [F.col("_key").asc(), F.col("block_id").asc()],
        totals={"_blocks": F.lit(1).cast("bigint"), "all_n": F.col("n"), "all_pos": F.col("pos")}, position="_at",
    )
    held = F.col("_at") <= F.ceil(F.col("_blocks") * F.lit(fraction))
    agg = placed.groupBy("trial").agg(
        F.sum(F.when(held, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(held, F.col("pos")).otherwise(0)).alias("pos"),
        F.max("all_n").alias("all_n"), F.max("all_pos").alias("all_pos"),
        F.array_sort(F.collect_list(F.when(held, F.col("block_id")))).alias("blocks"),
    )
    n, pos, all_n, all_pos = (F.col(c) for c in ("n", "pos", "all_n", "all_pos"))
    feasible = (pos > 0) & (pos < n) & (all_pos - pos > 0) & (all_pos - pos < all_n - n)
    want_n = F.greatest(F.lit(1), F.bround(all_n * F.lit(fraction), 0)).cast("double")
    want_pos = F.greatest(F.lit(1), F.bround(all_pos * F.lit(fraction), 0)).cast("double")
    score = F.abs(n - want_n) / want_n + F.abs(pos - want_pos) / want_pos
    scored = agg.where(feasible).withColumn("score", score)
    best = F.struct("trial", "score", "blocks", "n", "pos")
    return scored.agg(F.min_by(best, F.struct(F.round("score", 12), "trial")).alias("b")).select("b.*")


def split_manifest(
    df: DataFrame, label: str, block: str, *, test: float, validation: float, seed: int,
    all_blocks: DataFrame | None = None, trials: int = 256,
) -> DataFrame:
    """(block_id, partition): test blocks, then validation blocks from the rest (seed + 1), others train.

    ``df`` is the canonical realization; ``all_blocks`` adds blocks populated
    only in other realizations, which go to train.
    """
    rows = df.select(label, F.col(block).alias("block_id"))
    first = _chosen(grouped_holdout(rows, label, "block_id", test, seed, trials))
    rest = rows.where(~F.col("block_id").isin(first))
    second = _chosen(grouped_holdout(rest, label, "block_id", validation, seed + 1, trials))
    blocks = rows.select("block_id").distinct()
    if all_blocks is not None:
        blocks = blocks.unionByName(all_blocks.select(F.col(block).alias("block_id")).distinct()).distinct()
    part = F.when(F.col("block_id").isin(first), "test").when(F.col("block_id").isin(second), "validation").otherwise("train")
    return blocks.select("block_id", part.alias("partition"))


def _chosen(best: DataFrame) -> list[int]:
    row = best.first()
    if row is None or row["blocks"] is None:
        raise ValueError("no block split keeps both classes in every subset")
    return list(row["blocks"])
