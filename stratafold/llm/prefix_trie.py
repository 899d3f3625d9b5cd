"""Prefix trie of conversations by whole-sequence collapse.

Turns travel as 128-bit digests with their length; texts stay where they are read. A sequence's prefix of d turns is known
by a running 128-bit hash, which a stream over a conversation's sorted turns carries from turn to turn, so no
conversation is gathered. Conversations that end in the same hash are one weighted sequence with a list of ends; only
its least member's turns are spelled out as prefixes. A sequence that is another prefix's parent is a proper prefix; the
anti-join with the parents leaves the leaves. Prefix rows, weighted, are summed by node: members, least member, leaves
below, and the leaf that counts the node's own saving. Savings of a subtree are then sums along the paths of leaves from
their ends upwards, each node counted on one path only, summed by node again. Every sum combines before it is shuffled, and
joins on nodes meet one row a node on one side, so a prefix that a third of all conversations share is split by AQE.

End lists join in runs of numbers (one run of 4,096 at most a row); a digest over them takes the runs in order as a stream.

Edge cases: NULL conversation numbers belong to no conversation and are left out. NULL roles and texts are empty. Rows of one turn are
in the order of their digests. Repeated rows are further turns. Extra columns are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.common import partitions
from stratafold.session import cut

ROOT = bytes(16)
RUN = 4096


def own_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), item (16 bytes of role and text), size (the text's code points)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    both = F.concat_ws(":", F.octet_length(role).cast("string"), role, text)
    item = F.concat(*(F.unhex(F.lpad(F.hex(k), 16, "0")) for k in (F.xxhash64(both), F.xxhash64(F.lit(13), both))))
    light = rows.where("conv_id IS NOT NULL").select("conv_id", "turn", item.alias("item"), F.length(text).cast("bigint").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "item")
    return light.select("conv_id", F.row_number().over(order).alias("place"), "item", "size")


def rebuilt_turns(rows: DataFrame, group: int = 100, most_shared: int = 6) -> DataFrame:
    """Turns of every conversation after its first h are replaced by the first h of its group's head, h = crc32 mod ``most_shared``.

    A row with place 0 and neither item nor size stands before each conversation's turns.
    """
    own = own_turns(rows)
    head = F.col("conv_id") - F.col("conv_id") % group
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_shared).cast("int")
    convs = rows.where("conv_id IS NOT NULL").select("conv_id").distinct()
    # At most group members meet a head, each at most most_shared - 1 of its turns.
    heads = own.where((F.col("conv_id") == head) & (F.col("place") < most_shared)).withColumnRenamed("conv_id", "_head")
    first = convs.withColumns({"_head": head, "_h": shared}).join(heads, "_head").where(F.col("place") <= F.col("_h"))
    start = convs.select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("binary").alias("item"), F.lit(None).cast("bigint").alias("size"))
    columns = ["conv_id", "place", "item", "size"]
    return start.unionByName(first.select(columns)).unionByName(own.where(F.col("place") > shared).select(columns))


def prefixes(turns: DataFrame, carried: str | None = None, whole_only: bool = False) -> DataFrame:
    """conv_id, depth, node, parent, size for every prefix of every conversation, or for whole conversations only.

    ``turns`` has a row with place 0 for each conversation; ``carried`` names a number column of that row to repeat.
    """
    extra = [carried] if carried else []
    names = ["conv_id", "depth", "node", "parent", "size", *extra]
    columns = ["conv_id", "place", "item", "size", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last: tuple | None = None
        for batch in batches:
            for conv, place, item, size, *more in zip(*(batch.column(c).to_pylist() for c in columns)):
                if place == 0:
                    if whole_only and last is not None:
                        rows.append(last)
                    node, depth, kept = ROOT, 0, more
                    last = (conv, 0, ROOT, None, 0, *kept)
                else:
                    parent, node, depth = node, xxhash.xxh3_128_digest(node + item), depth + 1
                    last = (conv, depth, node, parent, size, *kept)
                if not whole_only:
                    rows.append(last)
            yield out(rows)
            rows = []
        if whole_only and last is not None:
            yield out([last])

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), *(pa.int64() for _ in extra)]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    # By a hash of the number: a shuffle by the number itself would be dropped after a join on it, and AQE may split that join's partitions.
    dealt = turns.select(*columns).repartition(partitions(turns.sparkSession), F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(run, "conv_id bigint, depth bigint, node binary, parent binary, size bigint" + "".join(f", {c} bigint" for c in extra))


def end_runs(whole: DataFrame) -> DataFrame:
    """node, run, ends: the numbers of the conversations that end at a node, ascending and joined by commas, by runs of 4,096 numbers."""
    run = F.floor(F.col("conv_id") / RUN)
    grouped = whole.groupBy("node", run.alias("run")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))  # no number occurs twice
    return grouped.select("node", "run", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ends"))


def end_digests(runs: DataFrame) -> DataFrame:
    """node, ends_sha256 of the runs of each node in order, joined by commas."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        node, state = None, None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.binary()), pa.array([r[1] for r in done], pa.string())], names=["node", "ends_sha256"])
            done.clear()
            return batch

        for batch in batches:
            for own, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if own != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = own, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            if done:
                yield out()
        if node is not None:
            done.append((node, state.hexdigest()))
            yield out()

    dealt = runs.repartition(partitions(runs.sparkSession), "node").sortWithinPartitions("node", "run")
    return dealt.select("node", "ends").mapInArrow(run, "node binary, ends_sha256 string")


def trie(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, parent, depth, conv_id, n_convs, n_leaves, n_children, saved, parent_conv_id) of ``turns``, and :func:`end_runs`.

    ``turns``: conv_id, place, item, size, with a row of place 0 for each conversation (see :func:`rebuilt_turns`).
    """
    turns = cut(turns)
    whole = cut(prefixes(turns, whole_only=True).select("conv_id", "node"))
    sequences = whole.groupBy("node").agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"))
    # One conversation of each sequence is spelled out; its least member's number names the sequence from here on.
    chosen = turns.join(sequences.select("conv_id", "weight"), "conv_id")
    spelled = cut(prefixes(chosen, "weight"))
    parents = spelled.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    leaves = sequences.join(parents, "node", "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    spelled = spelled.join(leaves, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0)))

    nodes = spelled.groupBy("node").agg(
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf") == 1, F.col("conv_id"))).alias("owner"), F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("size").alias("size"))
    nodes = cut(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("size")).drop("size"))

    paths = spelled.where("leaf = 1").select("conv_id", "depth", "node")
    # The root, which every path meets, saves nothing of its own and needs no join.
    counted = paths.where("depth > 0").join(nodes.where("depth > 0").select("node", "own", "owner"), "node")
    counted = counted.select("conv_id", "depth", "node", F.when(F.col("owner") == F.col("conv_id"), F.col("own")).otherwise(0).alias("own"))
    counted = counted.unionByName(paths.where("depth = 0").withColumn("own", F.lit(0).cast("bigint")))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    saved = counted.withColumn("own", F.sum("own").over(below)).groupBy("node").agg(F.sum("own").alias("saved"))

    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    full = nodes.drop("owner", "own").join(saved, "node").join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(above, "parent", "left"), end_runs(whole)


def _sql() -> str:
    from stratafold.llm.conversation_repair import crc32_sql
    return f"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS item, length(coalesce(text, '')) AS size
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS head, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
rebuilt AS (
    SELECT c.conv_id, t.place, t.item, t.size FROM convs c JOIN turns t ON t.conv_id = c.head AND t.place <= c.h
    UNION ALL SELECT c.conv_id, t.place, t.item, t.size FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h),
listed AS (SELECT c.conv_id, coalesce(list(r.item ORDER BY r.place) FILTER (r.item IS NOT NULL), []) AS items,
    coalesce(list(r.size ORDER BY r.place) FILTER (r.item IS NOT NULL), []) AS sizes FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id),
prefixes AS (SELECT conv_id, d, md5(array_to_string(items[:d], ',')) || d AS node, CASE WHEN d > 0 THEN md5(array_to_string(items[:d - 1], ',')) || (d - 1) END AS parent,
    CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(items) AS ends
    FROM (SELECT *, unnest(range(0, len(items) + 1)) AS d FROM listed)),
nodes AS (SELECT node, d, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * min(size) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY node, d),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT a.node, sum(n.own) AS saved_tokens, count(*) FILTER (c.node IS NULL) AS n_leaves
    FROM nodes n JOIN prefixes a ON a.conv_id = n.conv_id AND a.d <= n.d LEFT JOIN children c ON c.node = n.node GROUP BY a.node)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
    b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN children c ON c.node = n.node LEFT JOIN nodes p ON p.node = n.parent"""


SQL = _sql()
