"""Repeated passages: what the two passage operators share.

Every window of ``width`` symbols (bytes or words) is dealt by its anchor: the least-hashed run of ``anchor`` symbols in
it, the leftmost of equals. Equal windows have equal anchors at equal places, so windows need to meet only by anchor.
Neighbouring windows with one anchor form a run, whose symbols are its content. Runs travel as hashes first: an anchor
with one content repeats exactly if the content occurs twice; only where an anchor has several contents one example of
each is cut from the texts and solved together by the operator's own method. Copies fold at every step: texts by hash
(two 64-bit ones), runs within a batch, contents within an anchor.

What a group holds is the distinct contents of one anchor, not its occurrences. An anchor with more than ``most_contents``
of them (a common phrase in as many surroundings) is not gathered at all: its windows are counted by 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import partitions, text_bytes

MIX = np.uint64(0x9E3779B97F4A7C15)
PLACES = np.uint64((1 << 24) - 1)
STEP = 1 << 23  # windows looked at together; a place in a piece fits 24 bits
RANGES = "array<struct<first:bigint,last:bigint>>"


@dataclass(frozen=True)
class Unit:
    """How texts become symbols. ``symbols``: text to numbers; ``piece``: the text of some symbols."""

    width: int
    anchor: int
    symbols: Callable[[bytes], np.ndarray]
    piece: Callable[[bytes, int, int], bytes]


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` successive symbols, by doubling."""
    out, done, factor = scrambled(symbols.astype(np.uint64) + MIX), 1, MIX
    parts = []
    rest = size
    with np.errstate(over="ignore"):
        while True:
            if rest & 1:
                parts.append((out, done))
            rest >>= 1
            if not rest:
                break
            out = out[:len(out) - done] * factor + out[done:]
            factor = factor * MIX | np.uint64(1)
            done *= 2
        total, at = None, 0
        n = len(symbols) - size + 1
        for values, length in parts:
            own = values[at:at + n]
            total = own if total is None else total * factor + own
            at += length
        return scrambled(total)


def anchored_runs(symbols: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows: anchor's hash, the run's first window, its number of windows, and how far behind its start the anchor is."""
    n = len(symbols) - width + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    hashes = gram_hashes(symbols, anchor)
    spread = width - anchor + 1
    places = np.empty(n, np.int64)
    for begin in range(0, n, STEP):
        part = hashes[begin:min(begin + STEP, n) + spread - 1]
        least = (part & ~PLACES) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while 2 * size <= spread:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < spread:
            least = np.minimum(least[:len(least) - (spread - size)], least[spread - size:])
        places[begin:begin + len(least)] = begin + (least & PLACES).astype(np.int64)
    first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    at = places[first]
    return hashes[at].view(np.int64), first, np.diff(np.append(first, n)), at - first


def text_keys(text: str) -> tuple[Column, Column]:
    raw = text_bytes(text)
    return F.xxhash64(raw).alias("k1"), F.xxhash64(F.lit(7), raw).alias("k2")


def runs_of(docs: DataFrame, unit: Unit, text: str) -> DataFrame:
    """anchor, content, k1, k2, start, windows, copies (of the text within a batch)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()))
            copies: dict[tuple[int, int], int] = {}
            for key in keys:
                copies[key] = copies.get(key, 0) + 1
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            for key, raw in zip(keys, batch.column("raw")):
                times = copies.pop(key, 0)
                if not times:
                    continue
                symbols = unit.symbols(raw.as_py())
                anchors, first, windows, _ = anchored_runs(symbols, unit.width, unit.anchor)
                if not len(anchors):
                    continue
                flat, size = memoryview(np.ascontiguousarray(symbols)).cast("B"), symbols.itemsize
                ends = first + windows - 1 + unit.width
                content = np.array([xxhash.xxh3_64_intdigest(flat[a * size:b * size]) for a, b in zip(first.tolist(), ends.tolist())], np.uint64).view(np.int64)
                for column, values in zip(columns, (anchors, content, np.full(len(first), key[0]), np.full(len(first), key[1]), first, windows, np.full(len(first), times))):
                    column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns],
                                                 names=["anchor", "content", "k1", "k2", "start", "windows", "copies"])

    k1, k2 = text_keys(text)
    return docs.select(k1, k2, text_bytes(text).alias("raw")).mapInArrow(
        run, "anchor bigint, content bigint, k1 bigint, k2 bigint, start bigint, windows bigint, copies bigint")


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """k1, k2, raw: each text once."""
    k1, k2 = text_keys(text)
    return docs.select(k1, k2, text_bytes(text).alias("raw")).groupBy("k1", "k2").agg(F.first("raw").alias("raw"))


Solve = Callable[[list[tuple[int, int, int, bytes]]], list[list[tuple[int, int]]]]


def repeated_ranges(docs: DataFrame, unit: Unit, solve: Solve, text: str = "text", batch_bytes: int = 8 << 20, most_contents: int = 20_000) -> DataFrame:
    """k1, k2, raw, ranges: each distinct text with the symbol ranges (end exclusive) that repeated windows cover.

    ``solve`` gets, for whole anchor groups, (group number, copies, windows, content) and returns for each the ranges of
    its symbols that windows found twice or more cover.
    """
    found = runs_of(docs, unit, text)
    anchors = found.groupBy("anchor").agg(F.sum("copies").alias("n"), F.min("content").alias("c0"), F.max("content").alias("c1"))
    anchors = anchors.where("n > 1").select("anchor", (F.col("c0") != F.col("c1")).alias("several"))
    # Recomputed if an executor is lost; used for the examples and again for the occurrences.
    candidates = found.join(anchors, "anchor").persist(StorageLevel.DISK_ONLY)
    several = candidates.where("several")
    examples = several.groupBy("anchor", "content").agg(F.min(F.struct("k1", "k2", "start", "windows")).alias("e"), F.sum("copies").alias("n"))
    wanted = examples.groupBy("e.k1", "e.k2").agg(  # at most the runs of one text
        F.collect_list(F.struct("anchor", "content", "n", F.col("e.start").alias("start"), F.col("e.windows").alias("windows"))).alias("cut"))
    texts = distinct_texts(docs, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, cuts in zip(batch.column("raw"), batch.column("cut")):
                raw, cuts = raw.as_py(), cuts.as_py()
                pieces = [unit.piece(raw, c["start"], c["start"] + c["windows"] - 1 + unit.width) for c in cuts]
                yield pa.RecordBatch.from_pydict({**{k: [c[k] for c in cuts] for k in ("anchor", "content", "n", "windows")}, "piece": pieces},
                                                 schema=pa.schema([*((k, pa.int64()) for k in ("anchor", "content", "n", "windows")), ("piece", pa.binary())]))

    pieces = texts.join(wanted, ["k1", "k2"]).select("raw", "cut").mapInArrow(cut, "anchor bigint, content bigint, n bigint, windows bigint, piece binary")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None

        def out() -> pa.RecordBatch:
            numbers = {a: i for i, a in enumerate(dict.fromkeys(r[0] for r in rows))}
            ranges = solve([(numbers[r[0]], r[2], r[3], r[4]) for r in rows])
            return pa.RecordBatch.from_pydict(
                {"anchor": [r[0] for r in rows], "content": [r[1] for r in rows], "ranges": [[{"first": a, "last": b} for a, b in x] for x in ranges]},
                schema=pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("ranges", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]))

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size > batch_bytes and row[0] != last:
                    yield out()
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row[4]), row[0]
        if rows:
            yield out()

    # Counted on what is persisted; hardly ever is there any.
    crowded = examples.groupBy("anchor").count().where(F.col("count") > most_contents).select("anchor")
    counted = None
    if not crowded.isEmpty():
        counted = window_counts(pieces.join(crowded, "anchor", "left_semi"), unit)
        pieces = pieces.join(crowded, "anchor", "left_anti")
    parts = 4 * partitions(docs.sparkSession)
    solved = pieces.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(settle, f"anchor bigint, content bigint, ranges {RANGES}")
    solved = solved.where(F.size("ranges") > 0)
    if counted is not None:
        solved = solved.unionByName(counted)
    marked = several.select("anchor", "content", "k1", "k2", "start").join(solved, ["anchor", "content"]).select("k1", "k2", "start", "ranges")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("first"), (F.col("windows") - 1 + unit.width).alias("last")))
    single = candidates.where(~F.col("several")).select("k1", "k2", "start", whole.alias("ranges"))
    every = single.unionByName(marked).select("k1", "k2", F.transform("ranges", lambda r: F.struct(
        (r["first"] + F.col("start")).alias("first"), (r["last"] + F.col("start")).alias("last"))).alias("ranges"))
    # A text's own runs: collect_set drops what several batches with the same text report.
    by_text = every.groupBy("k1", "k2").agg(F.flatten(F.collect_set("ranges")).alias("ranges"))
    return texts.join(by_text, ["k1", "k2"], "left").select(
        "k1", "k2", "raw", F.coalesce("ranges", F.array().cast(RANGES)).alias("ranges"))


def window_counts(pieces: DataFrame, unit: Unit) -> DataFrame:
    """anchor, content, ranges: every window of the pieces on its own, counted by its hash and partly summed before the shuffle."""
    names = ["anchor", "content", "n", "first", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                symbols = unit.symbols(row["piece"])
                one, two = (gram_hashes(x, unit.width).view(np.int64) for x in (symbols, scrambled(symbols.astype(np.uint64) + np.uint64(99))))
                size = len(one)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, row[k]), pa.int64()) for k in names[:3]] + [pa.array(x, pa.int64()) for x in (np.arange(size), one, two)], names=names)

    windows = pieces.select("anchor", "content", "n", "piece").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    often = windows.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2")
    found = windows.join(often, ["h1", "h2"])
    return found.groupBy("anchor", "content").agg(  # at most a run's windows
        F.collect_list(F.struct("first", (F.col("first") + unit.width).alias("last"))).alias("ranges"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one, ascending."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
