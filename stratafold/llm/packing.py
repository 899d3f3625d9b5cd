"""Packing documents into training windows by order-preserving dynamic programming.

The documents of a partition, in their order, form one stream of token ids. A window is a stretch of at most ``width``
ids. It may end at a document's end, at a sentence's end (at a price), or every ``filler`` ids inside longer sentences
(at a higher price). With the ends ``p`` and the best cost ``f`` of each, the last window of a stream ending at ``p[j]``
starts at the ``p[i]`` that minimises ``f[i] + width - (p[j] - p[i])``, so the least ``f[i] + p[i]`` within reach is
kept in a monotone queue; windows of a power-of-two length need no padding and are further transitions. A stream is
solved in segments; the last window of a segment is carried into the next one. Near the stream's end every position may
be a cut, so that hardly any padding is left there.

Edge cases: a NULL or empty text is its closing id alone. Repeated rows are packed one by one. A text longer than a
window spans several. Documents longer than a segment are solved as one. An empty table gives an empty result. Columns
of ``docs`` other than the id and the text are not carried.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import text_bytes


@dataclass(frozen=True)
class Costs:
    """Prices in padding ids: of a window, of a cut at a sentence's end, of a cut elsewhere inside a document."""

    window: int = 16
    sentence: int = 6
    inside: int = 24
    filler: int = 64
    segment: int = 1 << 17


def encoder(vocabulary: str) -> tuple[Callable[[list[str]], list[list[int]]], np.ndarray]:
    """Ids of texts, and for each id whether it ends a sentence. ``vocabulary``: a .tiktoken or .json file, or the name of one of the public ones."""
    import base64

    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    if path.endswith(".tiktoken"):
        with open(path) as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
        model = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = {i: b for b, i in ranks.items()}
        encode = lambda texts: [model.encode_ordinary(t) for t in texts]
    else:
        from tokenizers import Tokenizer
        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        pieces = {i: model.decode([i]).encode() for i in range(model.get_vocab_size())}
        encode = lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    ends = np.zeros(max(pieces) + 2, bool)
    ends[[i for i, b in pieces.items() if b.rstrip(b" ").endswith((b".", b"!", b"?", b"\n"))]] = True
    return encode, ends


def cut_points(ids: np.ndarray, closes: np.ndarray, ends: np.ndarray, costs: Costs, every_from: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (from 0 to all ids) where a window may end, and their prices; from ``every_from`` on every position."""
    n = len(ids)
    price = np.full(n + 1, -1, np.int64)
    price[max(every_from, 0):] = costs.inside
    price[1:][ends[ids]] = costs.sentence
    price[closes] = 0
    price[[0, n]] = 0
    at = np.flatnonzero(price >= 0)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > costs.filler)
    if len(wide):
        more = np.concatenate([np.arange(at[k] + costs.filler, at[k + 1], costs.filler) for k in wide])
        price[more] = costs.inside
        at = np.flatnonzero(price >= 0)
    return at, price[at]


def best_cuts(at: np.ndarray, price: np.ndarray, width: int, costs: Costs) -> list[int]:
    """Cut positions of the cheapest windows, the last position included."""
    size = len(at)
    exact: list[list[int]] = [[] for _ in range(size)]
    step = 1
    while step <= width:
        place = np.searchsorted(at, at - step)
        for j in np.flatnonzero(at[np.minimum(place, size - 1)] == at - step).tolist():
            exact[j].append(int(place[j]))
        step *= 2
    p, extra = at.tolist(), (price + costs.window).tolist()
    f, g, back = [0] * size, [0] * size, [0] * size
    queue = deque([0])
    for j in range(1, size):
        here = p[j]
        while p[queue[0]] < here - width:
            queue.popleft()
        i = queue[0]
        best = g[i] + width - here
        for k in exact[j]:
            if f[k] < best:
                best, i = f[k], k
        f[j] = best = best + extra[j]
        g[j] = best = best + here
        back[j] = i
        while queue and g[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    cuts, j = [], size - 1
    while j:
        cuts.append(p[j])
        j = back[j]
    return cuts[::-1]


class Stream:
    """Ids of consecutive documents that are not in a window yet."""

    def __init__(self, width: int, costs: Costs, ends: np.ndarray, first: int):
        self.width, self.costs, self.ends, self.sequence = width, costs, ends, first
        self.parts: list[tuple[object, int, int, np.ndarray]] = []  # id, ids of the document before, ids of the whole document, ids
        self.held = 0

    def add(self, doc, ids: np.ndarray) -> None:
        self.parts.append((doc, 0, len(ids), ids))
        self.held += len(ids)

    def flush(self, last: bool) -> Iterator[tuple]:
        """Pieces (document, start, document ids, sequence, offset, ids) of all windows; of all but the last before the end."""
        if not self.held:
            return
        ids = np.concatenate([x[3] for x in self.parts])
        bounds = np.cumsum([0, *(len(x[3]) for x in self.parts)])
        at, price = cut_points(ids, bounds[1:], self.ends, self.costs, len(ids) - self.width if last else len(ids))
        cuts = best_cuts(at, price, self.width, self.costs)
        if not last:
            cuts = cuts[:-1]
        begin, k = 0, 0
        for end in cuts:
            a = begin
            while a < end:
                doc, before, whole, _ = self.parts[k]
                b = min(end, int(bounds[k + 1]))
                yield doc, before + a - int(bounds[k]), whole, self.sequence, a - begin, ids[a:b]
                k += b == bounds[k + 1]
                a = b
            begin, self.sequence = end, self.sequence + 1
        rest = []
        for j in range(k, len(self.parts)):
            doc, before, whole, own = self.parts[j]
            skip = max(begin - int(bounds[j]), 0)
            rest.append((doc, before + skip, whole, own[skip:]))
        self.parts, self.held = rest, len(ids) - begin


def pack(
    docs: DataFrame, width: int = 2048, closing_id: int = 1, vocabulary: str = "byte_bpe_50k.tiktoken", costs: Costs | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit, as bytes).

    ``sequence_id`` numbers windows in order within a partition of ``docs``; the partition's number is in its upper bits.
    """
    costs = costs or Costs()
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = encoder(vocabulary)
        stream = Stream(width, costs, ends, TaskContext.get().partitionId() << 40)
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        id_type = None

        def out(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            rows = list(pieces)
            if rows:
                columns = [pa.array([r[0] for r in rows], id_type), *(pa.array(x, pa.int64()) for x in (
                    [r[1] for r in rows], [len(r[5]) for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows])),
                    pa.array([r[5].astype("<u4").tobytes() for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            id_type = batch.column("doc_id").type
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("_bytes")):
                ids = np.array([*encode([raw.as_py().decode("utf-8", "replace")])[0], closing_id], np.uint32)
                stream.add(doc, ids)
                if stream.held >= costs.segment:
                    yield from out(stream.flush(False))
        yield from out(stream.flush(True))

    source = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("_bytes"))
    return source.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
