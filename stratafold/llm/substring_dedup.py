"""Substring removal by seed and extend over words.

Seeds are winnowed anchors: of every ``width`` successive words the least-hashed ``anchor`` words. Occurrences meet on
their anchor; from there matches are extended both ways at once for a whole batch of anchors: contents sorted by the words
from the anchor on, and by the words before it backwards, have their longest matches next to each other, so the lengths
to which neighbours agree tell which contents share any l words before and r from the anchor on, and no pair is listed.
What is extended to ``width`` words or more, joined into maximal stretches, is a repeat.

Words are compared by 64-bit hashes; a wrong match would need 35 of them to agree at once.

Edge cases: NULL and empty texts have no words; texts under ``width`` words keep all. Repeats may lie in one text and may
overlap. Repeated rows repeat each other's passages and so lose them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.repeats import RANGES, Unit, anchored_runs, merged, repeated_ranges, text_keys

ANCHOR = 8


def word_numbers(text: bytes) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in text.split()], np.uint64)


def word_unit(width: int) -> Unit:
    def piece(text: bytes, first: int, last: int) -> bytes:
        return b" ".join(text.split()[first:last])
    return Unit(width, min(ANCHOR, width), word_numbers, piece)


def _agreement(matrix: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by group and columns, and to how many columns a row agrees with the one before it (-1: other group)."""
    order = np.lexsort((*matrix.T[::-1], group)) if matrix.shape[1] else np.argsort(group, kind="stable")
    sorted_, groups = matrix[order], group[order]
    differs = np.column_stack([sorted_[1:] != sorted_[:-1], np.ones(max(len(order) - 1, 0), bool)])
    length = differs.argmax(1)
    length[groups[1:] != groups[:-1]] = -1
    return order, np.append(-1, length)


def extend(width: int):
    """A solver for :func:`repeated_ranges`."""
    anchor = min(ANCHOR, width)

    def solve(rows: list[tuple[int, int, int, bytes]]) -> list[list[tuple[int, int]]]:
        group = np.array([r[0] for r in rows])
        copies, windows = (np.array([r[i] for r in rows]) for i in (1, 2))
        numbers = [word_numbers(r[3]) for r in rows]
        size = len(rows)
        lead = np.array([_lead(x, width, anchor) for x in numbers])
        right, left = np.zeros((size, width), np.uint64), np.zeros((size, width - anchor), np.uint64)
        for i, x in enumerate(numbers):
            after, before = x[lead[i]:lead[i] + width], x[:lead[i]][::-1]
            right[i, :len(after)] = after
            left[i, :len(before)] = before
        by_right, agree_right = _agreement(right, group)
        by_left, agree_left = _agreement(left, group)
        twice = np.zeros((size, width - anchor + 1), bool)
        class_right, class_left = np.empty(size, np.int64), np.empty(size, np.int64)
        for before in range(width - anchor + 1):
            own = np.flatnonzero((before <= lead) & (before > lead - windows))
            if not len(own):
                continue
            class_right[by_right] = np.cumsum(agree_right < width - before)
            class_left[by_left] = np.cumsum(agree_left < before)
            _, place = np.unique(class_right[own] * (size + 1) + class_left[own], return_inverse=True)
            twice[own, before] = np.bincount(place, weights=copies[own])[place] > 1
        out: list[list[tuple[int, int]]] = []
        for i in range(size):
            starts = lead[i] - np.flatnonzero(twice[i])[::-1]
            out.append(merged([(s, s + width) for s in starts.tolist()]))
        return out

    return solve


def _lead(numbers: np.ndarray, width: int, anchor: int) -> int:
    return int(anchored_runs(numbers, width, anchor)[3][0])


def find_repeats(docs: DataFrame, width: int = 35, text: str = "text", most_contents: int = 20_000) -> DataFrame:
    """Each distinct text: k1, k2, n_words, n_removed, ranges (of words, maximal, end exclusive), kept (its other words, joined by one blank)."""
    found = repeated_ranges(docs, word_unit(width), extend(width), text, most_contents=most_contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, spans, kept = [], [], [], []
            for raw, ranges in zip(batch.column("raw"), batch.column("ranges").to_pylist()):
                words = raw.as_py().split()
                own = merged([(r["first"], r["last"]) for r in ranges])
                left, at = [], 0
                for a, b in own:
                    left += words[at:a]
                    at = b
                left += words[at:]
                total.append(len(words))
                gone.append(len(words) - len(left))
                spans.append([{"first": a, "last": b} for a, b in own])
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(spans, batch.column("ranges").type), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["k1", "k2", "n_words", "n_removed", "ranges", "kept"])

    return found.mapInArrow(run, f"k1 bigint, k2 bigint, n_words bigint, n_removed bigint, ranges {RANGES}, kept string")


def remove_repeats(docs: DataFrame, width: int = 35, text: str = "text") -> DataFrame:
    """``docs`` with the kept words as text (NULL stays NULL)."""
    k1, k2 = text_keys(text)
    found = find_repeats(docs, width, text).select("k1", "k2", F.col("kept").alias("_kept"))
    joined = docs.withColumns({"k1": k1, "k2": k2}).join(found, ["k1", "k2"], "left")
    return joined.withColumn(text, F.when(F.col(text).isNotNull(), F.col("_kept"))).select(*docs.columns)


#: Every window of 35 words against all others; a word goes if a repeated window starts at most 34 words before it.
SQL = r"""
WITH w AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT n, words[i] AS word, i, CASE WHEN i + 34 <= len(words) THEN md5(array_to_string(words[i:i + 34], ' ')) END AS key
      FROM w, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i)),
t AS (SELECT *, key IS NOT NULL AND count(*) OVER (PARTITION BY key) > 1 AS twice FROM p),
c AS (SELECT *, coalesce(i - max(CASE WHEN twice THEN i END) OVER (PARTITION BY n ORDER BY i) < 35, FALSE) AS gone FROM t),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY n ORDER BY i), FALSE) AS starts FROM c),
g AS (SELECT n, count(*) AS n_words, count_if(gone) AS n_removed, count_if(starts) AS n_ranges, string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY i) AS kept FROM r GROUP BY n)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_ranges, 0) AS INTEGER) AS n_ranges, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (n)
"""
