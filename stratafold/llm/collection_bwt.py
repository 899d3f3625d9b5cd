"""Passage removal by suffix arrays, built column by column for many texts at once.

Windows of ``width`` bytes are dealt by anchor (see ``repeats``); the contents that share anchors form collections of
bounded text. A collection's Burrows-Wheeler transform grows by one symbol of every text per round, from the last symbol
to the first: the symbols before the suffixes so far, sorted stably, place all suffixes that are one symbol longer, and
the common prefix of two new neighbours is one more than the least common prefix between the suffixes they extend. A
symbol is a column of eight bytes, on a grid through the anchor, where equal windows are aligned, so a text of a few
hundred bytes takes under a hundred rounds. The suffix order at 8-byte steps with its common prefixes says which windows agree
in their whole columns; the up to seven bytes at either end are compared as numbers.

Arrays of a round that exceed ``memory_bytes`` (one anchor with very many contents) are written to and read from
sequential files that vanish with the task.

Edge cases: NULL and empty texts have no bytes; texts under ``width`` bytes keep all. Repeats may lie in one text and may
overlap. Repeated rows repeat each other and lose all covered bytes. Cuts may fall inside a character, so kept bytes stay
binary; :func:`remove_repeats` replaces what is no character. An empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.repeats import RANGES, Unit, anchored_runs, merged, repeated_ranges, scrambled, text_keys

ANCHOR = 32
COLUMN = 8


def byte_values(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def byte_unit(width: int) -> Unit:
    return Unit(width, min(ANCHOR, width), byte_values, lambda text, first, last: text[first:last])


def kept(array: np.ndarray, memory_bytes: int) -> np.ndarray:
    """The array, or if it is large a sequential file with its values."""
    if array.nbytes <= memory_bytes:
        return array
    with tempfile.TemporaryFile() as file:
        array.tofile(file)
        file.seek(0)
        return np.memmap(file, array.dtype, "r+", shape=array.shape)


def least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of ``values[first:last + 1]`` for each pair."""
    if not len(first):
        return values[:0]
    span = last - first + 1
    level = np.frexp(span)[1] - 1
    out = np.empty(len(first), values.dtype)
    table, size = values, 1
    for k in range(int(level.max()) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[first[own]], table[last[own] - size + 1])
        if 2 * size <= len(values):
            table = np.minimum(table[:-size], table[size:])
        size *= 2
    return out


def suffix_order(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, memory_bytes: int = 64 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and common prefix with the suffix before, of all suffixes of a collection in order.

    ``symbols`` are numbers from 1 up; text i is ``symbols[starts[i]:starts[i] + sizes[i]]``. Texts end in terminators
    that come before all symbols, in the order of the texts, and agree with nothing.
    """
    depth = int(sizes.max(initial=0))
    small = np.uint8 if depth < 255 else np.uint32
    texts = np.arange(len(sizes))
    padded = np.concatenate([symbols[:0], [0], symbols]).astype(np.uint16 if symbols.max(initial=0) < 1 << 16 else np.uint32)

    def before(text: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at > 0, padded[starts[text] + at], 0)  # padded is one ahead

    text, at, common = texts, sizes.astype(np.int64), np.zeros(len(sizes), small)
    transform = before(text, at)
    for _ in range(depth):
        order = np.argsort(transform, kind="stable")
        order = order[np.count_nonzero(transform == 0):]  # where a text begins nothing is inserted
        longer = transform[order]
        same = np.append(False, longer[1:] == longer[:-1])
        prefix = np.zeros(len(order), small)
        pair = np.flatnonzero(same)
        prefix[pair] = 1 + least_between(common, order[pair - 1] + 1, order[pair])
        text = kept(np.concatenate([texts, text[order]]), memory_bytes)
        at = kept(np.concatenate([sizes, at[order] - 1]), memory_bytes)
        common = kept(np.concatenate([np.zeros(len(sizes), small), prefix]), memory_bytes)
        transform = kept(before(text, at), memory_bytes)
    return text, at, common


def solve_with(width: int, memory_bytes: int = 64 << 20):
    """A solver for :func:`repeated_ranges`."""
    anchor = min(ANCHOR, width)

    def solve(rows: list[tuple[int, int, int, bytes]]) -> list[list[tuple[int, int]]]:
        copies, windows = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        lengths = np.array([len(r[3]) for r in rows], np.int64)
        offsets = np.cumsum(lengths) - lengths
        joined = np.frombuffer(b"".join([*(r[3] for r in rows), bytes(COLUMN)]), np.uint8)
        numbers = np.zeros(len(joined) - COLUMN + 1, np.uint64)  # the eight bytes from each on
        for k in range(COLUMN):
            numbers = numbers << np.uint64(8) | joined[k:len(joined) - COLUMN + 1 + k]
        lead = np.array([int(anchored_runs(byte_values(r[3]), width, anchor)[3][0]) for r in rows], np.int64)
        phase = lead % COLUMN
        sizes = (lengths - phase) // COLUMN
        starts = np.cumsum(sizes) - sizes
        column = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
        cells = numbers[np.repeat(offsets + phase, sizes) + COLUMN * column]
        symbols = np.unique(cells, return_inverse=True)[1] + 1
        text, at, common = suffix_order(symbols, starts, sizes, memory_bytes)
        place = np.empty(len(text), np.int64)
        spot = np.cumsum(sizes + 1) - sizes - 1  # each text has one suffix more than symbols
        place[spot[text] + at] = np.arange(len(text))

        # All windows: text, first byte, first whole column, bytes before it.
        own = np.repeat(np.arange(len(rows)), windows)
        first = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        block = -((phase[own] - first) // COLUMN)
        head = phase[own] + COLUMN * block - first
        whole, tail = (width - head) // COLUMN, (width - head) % COLUMN
        agrees = np.empty(len(own), np.int64)
        for deep in np.unique(whole).tolist():
            these = np.flatnonzero(whole == deep)
            classes = np.cumsum(common < deep)
            agrees[these] = classes[place[spot[own[these]] + block[these]]]

        def ends(from_byte: np.ndarray, count: np.ndarray) -> np.ndarray:
            shift = (8 * (COLUMN - count)).astype(np.uint64)
            return np.where(count > 0, numbers[np.minimum(from_byte, len(numbers) - 1)] >> np.minimum(shift, np.uint64(63)), 0).astype(np.uint64)

        begin = offsets[own] + first
        with np.errstate(over="ignore"):
            key = scrambled(scrambled(agrees.astype(np.uint64) * np.uint64(COLUMN) + head.astype(np.uint64)) ^ ends(begin, head))
            key = scrambled(key ^ ends(begin + width - tail, tail))
        _, which = np.unique(key, return_inverse=True)
        twice = np.bincount(which, weights=copies[own])[which] > 1
        out: list[list[tuple[int, int]]] = []
        for flags in np.split(twice, np.cumsum(windows)[:-1]):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
            out.append(merged([(a, b - 1 + width) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]))
        return out

    return solve


def find_repeats(docs: DataFrame, width: int = 400, text: str = "text", batch_bytes: int = 512 << 10, most_contents: int = 20_000) -> DataFrame:
    """Each distinct text: k1, k2, n_bytes, n_removed, n_spans, ranges (of bytes, maximal, end exclusive), kept (its other bytes)."""
    found = repeated_ranges(docs, byte_unit(width), solve_with(width), text, batch_bytes, most_contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, left = [], []
            for raw, ranges in zip(batch.column("raw"), batch.column("ranges").to_pylist()):
                raw, own, parts, at = raw.as_py(), merged([(r["first"], r["last"]) for r in ranges]), [], 0
                for a, b in own:
                    parts.append(raw[at:a])
                    at = b
                spans.append([{"first": a, "last": b} for a, b in own])
                left.append(b"".join([*parts, raw[at:]]))
            sizes = [len(raw.as_py()) for raw in batch.column("raw")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(sizes, pa.int64()), pa.array([n - len(x) for n, x in zip(sizes, left)], pa.int64()),
                 pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, batch.column("ranges").type), pa.array(left, pa.binary())],
                names=["k1", "k2", "n_bytes", "n_removed", "n_spans", "ranges", "kept"])

    return found.mapInArrow(run, f"k1 bigint, k2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, ranges {RANGES}, kept binary")


def remove_repeats(docs: DataFrame, width: int = 400, text: str = "text") -> DataFrame:
    """``docs`` with the kept bytes as text (NULL stays NULL; a cut character becomes the replacement character)."""
    k1, k2 = text_keys(text)
    found = find_repeats(docs, width, text).select("k1", "k2", F.decode("kept", "UTF-8").alias("_kept"))
    joined = docs.withColumns({"k1": k1, "k2": k2}).join(found, ["k1", "k2"], "left")
    return joined.withColumn(text, F.when(F.col(text).isNotNull(), F.col("_kept"))).select(*docs.columns)
