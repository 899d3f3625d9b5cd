"""Exact inner-product search by columnar branch and bound.

Vectors are kept in blocks in vertical layout (a component of all vectors side by side). A block of queries meets a block
of candidates: scores grow component block by component block, heaviest first; after each, the mass that remains bounds
what a candidate can still gain (Cauchy-Schwarz), and once few pairs can reach the query's running k-th score only those
are carried on, compacted. A first pass of each query block over one candidate block gives every query a score to beat.
The queries are a stated set, so all blocks meet; a pair of blocks returns k rows a query and ids only.

Edge cases: vectors that are NULL, or hold NULL or non-finite components, take no part. Vectors of different lengths do
not meet. A row never meets itself, but may meet another row with its id. Ties go to the smaller id; equal scores of
rows with one id keep all rows. Fewer than k candidates give as many rows. An empty table gives an empty result. Scores
are exact 64-bit integers; components so large that a score could leave that range are refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.common import partitions
from stratafold.session import cut

BLOCK = "block bigint, width int, ids binary, queries binary, matrix binary"
DENSE = 0.2  # pairs are compacted once at most this share of them is left


def scaled(vector: str, factor: int = 256) -> Column:
    """floor(factor * x) of every component; NULL if any is NULL or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double"))))


def blocks(vectors: DataFrame, vec_id: str, vector: str, is_query: Column, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one length; ``queries`` flags the vectors that are queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(batch.column("v").value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            for i, (name, query) in enumerate(zip(batch.column("id").to_pylist(), batch.column("q").to_pylist())):
                own = held.setdefault(int(ends[i + 1] - ends[i]), [])
                own.append((name, query, flat[ends[i]:ends[i + 1]]))
                if len(own) == rows:
                    yield block(number, own)
                    number += 1
                    own.clear()
        for own in held.values():
            if own:
                yield block(number, own)
                number += 1

    def block(number: int, own: list) -> pa.RecordBatch:
        matrix = np.array([v for _, _, v in own], "<i8").reshape(len(own), len(own[0][2])).T  # vertical
        return pa.RecordBatch.from_pydict({
            "block": [number], "width": pa.array([len(matrix)], pa.int32()), "ids": [np.array([n for n, _, _ in own], "<i8").tobytes()],
            "queries": [np.array([q for _, q, _ in own], np.uint8).tobytes()], "matrix": [np.ascontiguousarray(matrix).tobytes()]})

    usable = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), scaled(vector).alias("v"))
    return usable.where(F.col("id").isNotNull() & F.col("v").isNotNull()).mapInArrow(run, BLOCK)


def query_blocks(from_blocks: DataFrame, rows: int) -> DataFrame:
    """The queries of all blocks, gathered into blocks of about ``rows``: number, width, home (block << 20 | place), ids, matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def emit(width: int) -> pa.RecordBatch:
            nonlocal number
            own = held.pop(width)
            number += 1
            matrix = np.concatenate([m for _, _, m in own], axis=1)
            return pa.RecordBatch.from_pydict({
                "number": [number], "width": pa.array([width], pa.int32()), "home": [np.concatenate([h for h, _, _ in own]).tobytes()],
                "ids": [np.concatenate([n for _, n, _ in own]).tobytes()], "matrix": [np.ascontiguousarray(matrix).tobytes()]})

        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                at = np.flatnonzero(np.frombuffer(row["queries"], np.uint8))
                if len(at):
                    matrix = np.frombuffer(row["matrix"], "<i8").reshape(row["width"], len(ids))[:, at]
                    own = held.setdefault(row["width"], [])
                    own.append((row["block"] << 20 | at, ids[at], matrix))
                    if sum(len(h) for h, _, _ in own) >= rows:
                        yield emit(row["width"])
        for width in list(held):
            yield emit(width)

    return from_blocks.mapInArrow(run, "number bigint, width int, home binary, ids binary, matrix binary")


def best_pairs(q: np.ndarray, home: np.ndarray, v: np.ndarray, block: int, ids: np.ndarray, k: int, least: np.ndarray, step: int = 8):
    """For each query the places and scores of at most k candidates with the highest scores, all at least ``least`` (else -1)."""
    width, n = v.shape
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(width, 1)
    if top >= 2**63:
        raise ValueError("components too large: a score would not fit 64 bits")
    kind = np.float64 if top < 2**53 else np.int64  # both exact
    order = np.argsort(-((q.astype(float) ** 2).sum(1) * (v.astype(float) ** 2).sum(1)), kind="stable")
    q, v = q[order].astype(kind), v[order].astype(kind)
    cuts = [*range(0, width, step), width]
    masses = [(np.sqrt((q[c:].astype(float) ** 2).sum(0)), np.sqrt((v[c:].astype(float) ** 2).sum(0))) for c in cuts[1:]]
    own = np.full(q.shape[1], -1)
    mine = home >> 20 == block
    own[mine] = home[mine] & 0xFFFFF
    score = np.zeros((q.shape[1], n), kind)
    rows = cols = values = None
    for b, (a, z) in enumerate(zip(cuts, cuts[1:])):
        mass_q, mass_v = masses[b]
        if rows is None:
            score += q[a:z].T @ v[a:z]
            open_ = score + mass_q[:, None] * mass_v[None] * (1 + 1e-9) + 1e-6 >= least[:, None]
            if z < width and open_.mean() <= DENSE:
                rows, cols = np.nonzero(open_)
                values = score[rows, cols]
        else:
            values = values + np.einsum("ij,ij->j", q[a:z][:, rows], v[a:z][:, cols])
            alive = values + mass_q[rows] * mass_v[cols] * (1 + 1e-9) + 1e-6 >= least[rows]
            rows, cols, values = rows[alive], cols[alive], values[alive]
    if rows is None:
        # The k-th best of a query is a further bound before its pairs are listed.
        if n > k + 1:
            free = score.copy()
            free[np.flatnonzero(own >= 0), own[own >= 0]] = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
            least = np.maximum(least, np.partition(free, n - k, axis=1)[:, n - k])
        rows, cols = np.nonzero(score >= least[:, None])
        values = score[rows, cols]
    other = cols != own[rows]
    rows, cols, values = rows[other], cols[other], values[other]
    best = np.lexsort((cols, ids[cols], -values, rows))
    rows, cols, values = rows[best], cols[best], values[best]
    first = np.searchsorted(rows, rows)
    kept = np.arange(len(rows)) - first < k
    return rows[kept], cols[kept], values[kept].astype(np.int64)


LOWEST = -2.0**63


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", block_rows: int = 4096, query_rows: int = 512,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest scores among all other rows."""
    spark = vectors.sparkSession
    parts = partitions(spark)
    stored = cut(blocks(vectors, vec_id, vector, is_query, block_rows))
    asked = cut(query_blocks(stored.repartition(max(1, parts // 4), "block"), query_rows))
    # Every query block meets the first block of its width that holds k + 1 vectors: a score to beat.
    full = stored.where(F.octet_length("ids") > 8 * (k + 1)).groupBy("width").agg(F.min("block").alias("block"))
    seeds = stored.join(full, ["width", "block"], "left_semi")

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, home = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["home"], "<i8")
                q, v = (np.frombuffer(r[x], "<i8").reshape(r["width"], n) for x, n in (("asked", len(home)), ("matrix", len(ids))))
                rows, _, values = best_pairs(q, home, v, r["block"], ids, k, np.full(len(home), LOWEST))
                out = np.full(len(home), LOWEST)
                last = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)) if len(rows) else rows
                enough = np.bincount(rows, minlength=len(home)) >= k
                out[rows[last]] = values[last]
                out[~enough] = LOWEST
                yield pa.RecordBatch.from_pydict({"number": [r["number"]], "least": [out.tobytes()]})

    named = asked.select("number", "width", "home", F.col("matrix").alias("asked"), F.col("ids").alias("query_ids"))
    least = named.drop("query_ids").join(seeds, "width").mapInArrow(floors, "number bigint, least binary")
    ready = cut(named.join(least, "number", "left"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, home, names = (np.frombuffer(r[x], "<i8") for x in ("ids", "home", "query_ids"))
                q, v = (np.frombuffer(r[x], "<i8").reshape(r["width"], n) for x, n in (("asked", len(home)), ("matrix", len(ids))))
                bar = np.full(len(home), LOWEST) if r["least"] is None else np.frombuffer(r["least"])
                rows, cols, values = best_pairs(q, home, v, r["block"], ids, k, bar)
                yield pa.RecordBatch.from_pydict({"home": home[rows], "query_id": names[rows], "vec_id": ids[cols], "place": r["block"] << 20 | cols, "score": values})

    # Candidate blocks are dealt into slots and stay there; every slot gets all query blocks.
    slots = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("slot")
    dealt = stored.drop("queries").withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    pairs = dealt.join(ready.select("*", slots), ["width", "slot"])
    found = pairs.mapInArrow(meet, "home bigint, query_id bigint, vec_id bigint, place bigint, score bigint")
    best = Window.partitionBy("home").orderBy(F.desc("score"), "vec_id", "place")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.n <> c.n AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
