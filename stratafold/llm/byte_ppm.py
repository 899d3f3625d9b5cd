"""Document likelihood by prediction by partial matching over bytes.

Texts are lower-cased (A-Z), their words joined by one blank and closed by a line feed. The model is the trie of the last
``order`` bytes trained on all training documents, with escape method D and full symbol exclusion: a symbol unseen in a
context pays the context's escape and is looked up in the next shorter one without the symbols already ruled out, down to
a uniform choice among bytes never seen. Next to it the same pass gives a smoothed unigram score over words.

As a probability depends on ``order + 1`` bytes only, texts never travel to the model. Documents are dealt into blocks of a
few megabytes; a block sends the counts of its distinct byte strings to the parts of the trie and asks for the
probabilities of those it needs. A part owns the contexts that end in certain two bytes, so all orders from two on are
whole inside it; the two shortest are a table of at most 65,536 counts that every task holds. Parts sum counts first and
then answer request after request, so what a part holds is its share of the trie. The trie grows with the corpus.

Edge cases: NULL and empty texts consist of the end alone. Repeated rows are scored alike, one row each. Without any
training text bytes are uniform. A NULL id counts as a training document. An empty table gives an empty result. Only the
id and the text of the input are used.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import partitions, text_bytes

MOST_PARTS = 4096
GRAMS, WORDS, ASK_GRAMS, ASK_WORDS = range(4)  # in this order within a part
ROWS = "part int, kind int, block bigint, keys binary, counts binary"


def normal_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def spelled(words: list[bytes]) -> bytes:
    return b" ".join(words) + b"\n"


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``order`` + 1 bytes up to each position as numbers, and where each text starts; line feeds stand before a text."""
    pad = b"\n" * order
    joined = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    codes = np.zeros(max(len(joined) - order, 0), np.int64)
    for k in range(order + 1):
        codes <<= 8
        codes |= joined[k:len(joined) - order + k]
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + order) - lengths - order
    inside = np.ones(len(codes), bool)
    for k in range(order):  # positions that belong to the next text's padding
        at = starts[1:] - order + k
        inside[at[at >= 0]] = False
    return codes[inside], np.cumsum(lengths) - lengths


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    return ((grams >> 8 & 0xFFFF) * 2654435761 % (1 << 32) >> 8) % parts


def word_part(word: bytes, parts: int) -> int:
    return zlib.crc32(word) % parts


class Trie:
    """Counts of all contexts that share this part, by order; the shortest two come from ``pairs`` (counts of two bytes)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int, pairs: np.ndarray):
        self.order = order
        known = np.flatnonzero(pairs)
        own = {order: (grams, counts), 1: (known, pairs[known])}
        for k in range(order - 1, 1, -1):
            own[k] = _fold(own[k + 1][0] & (1 << 8 * (k + 1)) - 1, own[k + 1][1])
        own[0] = _fold(known & 0xFF, pairs[known])
        if order == 1:
            own[1] = (known, pairs[known])
        self.grams = {k: own[k] for k in range(order + 1)}
        self.contexts = {}
        for k, (g, n) in self.grams.items():
            context, first = np.unique(g >> 8, return_index=True)
            total = np.add.reduceat(n, first) if len(g) else n
            distinct = np.diff(np.append(first, len(g)))
            shorter = np.zeros(len(context), np.int64)
            if k and len(g):
                s, m = self.grams[k - 1]
                shorter = np.add.reduceat(m[np.searchsorted(s, g & (1 << 8 * k) - 1)], first)
            self.contexts[k] = (context, total, distinct, shorter)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        out = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        ruled_n, ruled_q = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
        for k in range(self.order, -1, -1):
            g = grams[open_] & (1 << 8 * (k + 1)) - 1
            context, total, distinct, shorter = self.contexts[k]
            at, seen = _find(context, g >> 8)
            t = np.where(seen, total[at] if len(total) else 0, 0) - np.where(seen, ruled_n[open_], 0)
            q = np.where(seen, distinct[at] if len(total) else 0, 0) - np.where(seen, ruled_q[open_], 0)
            spot, found = _find(self.grams[k][0], g)
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = np.log10((2 * self.grams[k][1][spot] - 1) / (2 * t)) if len(self.grams[k][0]) else np.zeros(len(g))
                miss = np.log10(q / (2 * t))
            out[open_] += np.where(found, hit, np.where(t > 0, miss, 0.0))
            ruled_n[open_] = np.where(seen, shorter[at] if len(total) else 0, 0)
            ruled_q[open_] = np.where(seen, distinct[at] if len(total) else 0, 0)
            open_ = open_[~found]
        out[open_] -= np.log10(256 - ruled_q[open_])
        return out


def _fold(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _first_pass(docs: DataFrame, train: Column) -> tuple[np.ndarray, int]:
    """Counts of two successive bytes in training texts (at most 65,536) and the bytes of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, size = np.zeros(1 << 16, np.int64), 0
        for batch in batches:
            for raw, use in zip(batch.column("raw"), batch.column("train").to_pylist()):
                raw = raw.as_py()
                size += len(raw)
                if use:
                    text = np.frombuffer(b"\n" + spelled(normal_words(raw)), np.uint8).astype(np.int64)
                    if len(text) > 1 << 14:
                        pairs += np.bincount(text[:-1] << 8 | text[1:], minlength=1 << 16)
                    else:
                        np.add.at(pairs, text[:-1] << 8 | text[1:], 1)
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_pydict({"pair": np.append(at, -1), "n": np.append(pairs[at], size)})

    rows = docs.select("raw", train.alias("train")).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    pairs, size = np.zeros(1 << 16, np.int64), 0
    for pair, n in rows:
        if pair < 0:
            size = n
        else:
            pairs[pair] = n
    return pairs, size


def _block(table: pa.Table, order: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words by document, grams of all positions as codes into distinct sorted ones, and where documents start."""
    words = [normal_words(raw.as_py()) for raw in table.column("raw")]
    grams, starts = grams_of([spelled(w) for w in words], order)
    codes, distinct = pd.factorize(grams)
    rank = np.argsort(distinct, kind="stable")
    back = np.empty(len(rank), np.int64)
    back[rank] = np.arange(len(rank))
    return words, back[codes], distinct[rank], starts, np.diff(np.append(starts, len(grams)))


def score(
    docs: DataFrame, held_out: Column, order: int = 5, block_bytes: int = 8 << 20, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, n_bytes, score for every row.

    Rows with a true ``held_out`` (NULL: false) are scored but not learned from.
    """
    spark = docs.sparkSession
    parts = min(MOST_PARTS, max(partitions(spark), 2))
    named = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("raw"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    kind = named.schema["doc_id"].dataType.simpleString()
    pairs, size = _first_pass(named, ~F.col("held_out"))
    n_blocks = max(1, -(-size // block_bytes))
    dealt = named.withColumn("block", F.pmod(F.xxhash64("doc_id", "raw"), F.lit(n_blocks)))

    def count(key: tuple, batches) -> pa.Table:
        table = pa.Table.from_batches(batches) if not isinstance(batches, pa.Table) else batches
        words, codes, distinct, _, lengths = _block(table, order)
        held = np.array(table.column("held_out").to_pylist(), bool)
        learned = np.bincount(codes[np.repeat(~held, lengths)], minlength=len(distinct))
        rows = {c: [] for c in ("part", "kind", "keys", "counts")}

        def emit(part, kind, keys, counts):
            for name, value in zip(rows, (part, kind, keys, counts)):
                rows[name].append(value)

        part = part_of(distinct, parts)
        for p in range(parts):
            mine = part == p
            emit(p, ASK_GRAMS, _steps(distinct[mine]), None)
            mine &= learned > 0
            emit(p, GRAMS, _steps(distinct[mine]), learned[mine].astype(np.int64).tobytes())
        seen: Counter = Counter()
        for w, out in zip(words, held):
            if not out:
                seen.update(w)
                seen[b""] += 1  # the end
        for k, vocabulary in ((WORDS, sorted(seen)), (ASK_WORDS, _vocabulary(words))):
            lists: list[list[bytes]] = [[] for _ in range(parts)]
            for w in vocabulary:
                lists[word_part(w, parts)].append(w)
            for p, own in enumerate(lists):
                emit(p, k, _listed(own), np.array([seen[w] for w in own], np.int64).tobytes() if k == WORDS else None)
        size = len(rows["part"])
        return pa.table([pa.array(rows["part"], pa.int32()), pa.array(rows["kind"], pa.int32()), pa.array([key[0].as_py()] * size, pa.int64()),
                         pa.array(rows["keys"], pa.binary()), pa.array(rows["counts"], pa.binary())], names=["part", "kind", "block", "keys", "counts"])

    asked = dealt.groupBy("block").applyInArrow(_grouped(count), ROWS)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie, gathered, keys, counts, vocabulary = None, None, [], None, None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != now:
                    now, trie, gathered, vocabulary = r["part"], None, [], {}
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if r["kind"] == GRAMS:
                    gathered.append((_from_steps(r["keys"]), np.frombuffer(r["counts"], np.int64)))
                    if len(gathered) == 16:
                        keys, counts = _merge(keys, counts, gathered)
                elif r["kind"] == WORDS:
                    for w, n in zip(_unlisted(r["keys"]), np.frombuffer(r["counts"], np.int64).tolist()):
                        vocabulary[w] = vocabulary.get(w, 0) + n
                else:
                    if trie is None:
                        keys, counts = _merge(keys, counts, gathered)
                        trie = Trie(keys, counts, order, pairs)
                        tokens = sum(vocabulary.values())
                    if r["kind"] == ASK_GRAMS:
                        values = trie.log10(_from_steps(r["keys"]))
                    else:
                        values = np.array([len(vocabulary), tokens, *(vocabulary.get(w, 0) for w in _unlisted(r["keys"]))], np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "block": [r["block"]], "kind": pa.array([r["kind"]], pa.int32()), "part": pa.array([now], pa.int32()), "answers": [values.tobytes()]})

    answers = asked.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(answer, "block bigint, kind int, part int, answers binary")

    def finish(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        words, codes, distinct, starts, lengths = _block(table, order)
        logs, part = np.zeros(len(distinct)), part_of(distinct, parts)
        vocabulary = _vocabulary(words)
        lists: list[list[bytes]] = [[] for _ in range(parts)]
        for w in vocabulary:
            lists[word_part(w, parts)].append(w)
        known: dict[bytes, int] = {}
        types = tokens = 0
        for r in replies.to_pylist():
            if r["kind"] == ASK_GRAMS:
                logs[part == r["part"]] = np.frombuffer(r["answers"])
            else:
                values = np.frombuffer(r["answers"], np.int64).tolist()
                types, tokens = types + values[0], tokens + values[1]
                known.update(zip(lists[r["part"]], values[2:]))
        scores = np.add.reduceat(logs[codes], starts) if len(starts) else np.zeros(0)
        weight = {w: np.log10(c + 0.1) for w, c in known.items()}
        whole = float(np.log10(tokens + 0.1 * (types + 1)))
        base = [float(sum(map(weight.__getitem__, w)) + weight[b""]) - (len(w) + 1) * whole for w in words]
        seen = {w for w, c in known.items() if c}
        hits = [sum(map(seen.__contains__, w)) + (b"" in seen) for w in words]
        size = len(words)
        return pa.table([table.column("doc_id"), table.column("held_out"), pa.array([len(w) + 1 for w in words], pa.int64()), pa.array(hits, pa.int64()),
                         pa.array([tokens] * size, pa.int64()), pa.array(base, pa.float64()), pa.array(lengths, pa.int64()), pa.array(scores, pa.float64())],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "n_bytes", "score"])

    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, n_bytes bigint, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_grouped(finish), out)


def _grouped(function: Callable) -> Callable:
    """Give ``function`` whole tables, with the annotations that mark the table form."""
    if function.__code__.co_argcount == 3:
        def two(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
            return function(key, left, right)
        return two

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return function(key, table)
    return one


def _merge(keys: np.ndarray, counts: np.ndarray, gathered: list) -> tuple[np.ndarray, np.ndarray]:
    if gathered:
        keys, counts = _fold(np.concatenate([keys, *(k for k, _ in gathered)]), np.concatenate([counts, *(n for _, n in gathered)]))
        gathered.clear()
    return keys, counts


def _steps(ascending: np.ndarray) -> bytes:
    """Differences compress well on the wire."""
    return np.diff(ascending, prepend=0).tobytes()


def _from_steps(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.int64))


def _vocabulary(words: list[list[bytes]]) -> list[bytes]:
    return sorted({b""}.union(*words))


def _listed(words: list[bytes]) -> bytes:
    """Words hold no line feed; each is closed by one."""
    return b"".join(w + b"\n" for w in words)


def _unlisted(listed: bytes) -> list[bytes]:
    return listed.split(b"\n")[:-1]
