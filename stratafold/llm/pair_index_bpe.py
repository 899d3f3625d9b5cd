"""Byte-pair encoding by an index of pair occurrences, and decoding.

A block of a partition's texts is cut at ASCII white space, and every distinct chunk that is new is encoded once. The
vocabulary file's own normalizer and splitter turn chunks into pieces; pieces become symbols, one per byte, and all
pieces of the block lie in one array. An index maps each rank to all positions of its pair. Ranks that occur are
taken in ascending order; at all its positions the pair is replaced, and the two pairs that arise around each join the
lists of their ranks. Where one of them could rank below the current pair, positions are taken one by one, and the rest
of the list waits until the lower one is done, so every piece sees its merges in the very order that one-by-one
encoding gives it. Lists are not cleaned: a position whose pair is gone is skipped.

Cutting at white space first changes nothing: the splitter drops white space, and nothing composes with it. Strings of
special tokens inside a text become those tokens, as the library does by default. Chunks keep their ids for later blocks
of the task, up to ``held_bytes``; then they are encoded anew.

Edge cases: NULL and empty texts, and texts of white space alone, have no ids. Repeated rows are encoded alike. A text
without white space is one chunk; memory grows with its length only. Bytes that are no UTF-8 count as replacement
characters. Other columns are carried; those named like result columns are replaced. An empty table gives an empty
result. Ids unknown to the vocabulary are an error when decoding, as is a blob that is no whole number of ids.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import blobs, blocks, text_bytes

VOCABULARY = "word_bpe_49k.json"
BLOCK_BYTES = 2 << 20
HELD_BYTES = 40 << 20


def file_of(vocabulary: str) -> str:
    """``vocabulary`` if it is a path, else the public one of that name on this machine."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers
    return public_tokenizers.path(vocabulary)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable and no blank, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


#: The steps before merging for which most chunks need no library call: normalizer and splitter as the file words them.
PLAIN_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})
ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: ASCII and the letters of Latin-1, which are composed already and have lower case letters of Latin-1 or none.
LATIN = re.compile(r"[\x00-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")


class Vocabulary:
    """Tokens, merges and the steps before merging of a byte-level vocabulary file with word-end marks."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer
        path = file_of(vocabulary)
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError(f"{vocabulary} is no plain byte-pair vocabulary")
        ids = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.added = {a["content"]: a["id"] for a in whole["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.added.values()]) + 1)
        for token, i in [*ids.items(), *self.added.items()]:
            self.tokens[i] = token
        characters = byte_characters()
        self.inner, self.last = (np.array([ids[c + mark] for c in characters]) for mark in ("", end))
        self.of_character = {c: b for b, c in enumerate(characters)}
        self.merge: dict[int, tuple[int, int]] = {}  # left << 32 | right: rank, id
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[ids[a] << 32 | ids[b]] = (rank, ids[a + b])
        codes = np.array(list(self.merge), np.int64)
        ranks = np.array([r for r, _ in self.merge.values()], np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], ranks[order]
        left, right, made = codes >> 32, codes & 0xFFFFFFFF, np.array([i for _, i in self.merge.values()], np.int64)
        lowest = np.full(len(self.tokens), len(codes))
        np.minimum.at(lowest, left, ranks)
        np.minimum.at(lowest, right, ranks)
        #: By rank: the pair, its symbol, and whether a pair with that symbol ranks lower.
        self.pairs = dict(zip(ranks.tolist(), zip(left.tolist(), right.tolist(), made.tolist(), (lowest[made] < ranks).tolist())))
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.plain = (whole["normalizer"], whole["pre_tokenizer"]) == PLAIN_STEPS
        self.marks = re.compile(b"|".join(re.escape(t.encode()) for t in self.added)) if self.added else None
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def pieces(self, chunk: bytes) -> list[bytes | int]:
        """Pieces of a chunk; a special token is its id."""
        plain = self.plain and not (self.marks and self.marks.search(chunk))
        if plain and chunk.isascii():
            return [chunk.lower()] if chunk.isalpha() else ASCII_PIECES.findall(chunk.lower())
        text = chunk.decode("utf-8", "replace")
        if plain and LATIN.fullmatch(text):
            return [p.encode() for p in LATIN_PIECES.findall(text.lower())]
        out: list[bytes | int] = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out.extend(bytes(map(self.of_character.__getitem__, p)) for p, _ in self.split(self.normalize(part)))
        return out

    def rank_of(self, pairs: np.ndarray) -> np.ndarray:
        """Ranks of pair codes, -1 for what is no pair."""
        spot = np.minimum(np.searchsorted(self.codes, pairs), len(self.codes) - 1)
        return np.where(self.codes[spot] == pairs, self.ranks[spot], -1)


def merge_all(pieces: list[bytes], vocabulary: Vocabulary, many: int = 48) -> list[bytes]:
    """Ids (little-endian unsigned 32-bit) of each piece, by one pair index over all of them.

    A list of ``many`` positions or more is replaced at once, unless order within it matters: if its two symbols are equal,
    or if a pair that arises could rank below it.
    """
    if not pieces:
        return []
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    whole = vocabulary.inner[raw]
    whole[ends - 1] = vocabulary.last[raw[ends - 1]]
    size = len(whole)
    symbol, following, preceding = array("q", whole.tobytes()), array("q", np.arange(1, size + 1).tobytes()), array("q", np.arange(-1, size - 1).tobytes())
    symbols, after, before = (np.frombuffer(x, np.int64) for x in (symbol, following, preceding))  # the same memory
    after[ends - 1] = -1
    before[ends[:-1]] = -1

    inside = np.flatnonzero(after >= 0)
    ranks = vocabulary.rank_of(symbols[inside] << 32 | symbols[after[inside]])
    at, ranks = inside[ranks >= 0], ranks[ranks >= 0]
    order = np.argsort(ranks, kind="stable")
    ranks, at = ranks[order], at[order]
    active, first = np.unique(ranks, return_index=True)
    index: dict[int, list[int]] = {r: x.tolist() for r, x in zip(active.tolist(), np.split(at, first[1:]))}
    heap = active.tolist()  # ascending, so a heap
    merge = vocabulary.merge

    def arises(rank: int, position: int) -> None:
        if rank in index:
            index[rank].append(position)
        else:
            index[rank] = [position]
            heapq.heappush(heap, rank)

    while heap:
        rank = heapq.heappop(heap)
        positions = index.pop(rank, None)
        if positions is None:
            continue
        left, right, made, ordered = vocabulary.pairs[rank]
        if len(positions) >= many and left != right and not ordered:
            i = np.sort(np.array(positions))
            i = i[np.append(True, i[1:] != i[:-1])]
            j = after[i]
            holds = (symbols[i] == left) & (j >= 0)
            holds &= symbols[j] == right  # of a piece's last symbol any other, whose verdict is not used
            i, j = i[holds], j[holds]
            k = after[j]
            symbols[i], symbols[j] = made, -1
            after[i] = k
            inner = k >= 0
            before[k[inner]] = i[inner]
            p = before[i]
            outer = p >= 0
            place = np.concatenate([i[inner], p[outer]])
            new = vocabulary.rank_of(np.concatenate([made << 32 | symbols[k[inner]], symbols[p[outer]] << 32 | made]))
            for r, x in zip(new[new >= 0].tolist(), place[new >= 0].tolist()):
                if r in index:
                    index[r].append(x)
                else:
                    index[r] = [x]
                    heapq.heappush(heap, r)
            continue
        positions.sort()
        for done, i in enumerate(positions, 1):
            j = following[i]
            if j < 0 or symbol[i] != left or symbol[j] != right:
                continue
            symbol[i], symbol[j] = made, -1
            following[i] = k = following[j]
            sooner = False
            if k >= 0:
                preceding[k] = i
                found = merge.get(made << 32 | symbol[k])
                if found:
                    sooner = found[0] < rank
                    arises(found[0], i)
            p = preceding[i]
            if p >= 0:
                found = merge.get(symbol[p] << 32 | made)
                if found:
                    sooner |= found[0] < rank
                    arises(found[0], p)
            if sooner:
                if done < len(positions):
                    index[rank] = positions[done:]
                    heapq.heappush(heap, rank)
                break
    live = symbols >= 0
    kept = np.cumsum(live)[ends - 1]
    flat = symbols[live].astype("<u4").tobytes()
    cuts = [0, *(4 * kept).tolist()]
    return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


class Encoder:
    """Encodes blocks of texts; chunks keep their ids up to ``held_bytes``."""

    def __init__(self, vocabulary: Vocabulary, held_bytes: int = HELD_BYTES):
        self.vocabulary, self.held_bytes = vocabulary, held_bytes
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def encode(self, texts: list[bytes]) -> list[bytes]:
        chunked = [t.split() for t in texts]  # at ASCII white space
        new = set().union(*chunked).difference(self.known)
        parts = {c: self.vocabulary.pieces(c) for c in new}
        distinct = list({p for x in parts.values() for p in x if isinstance(p, bytes)})
        ids = dict(zip(distinct, merge_all(distinct, self.vocabulary)))
        for c, x in parts.items():
            self.known[c] = ids[x[0]] if len(x) == 1 and isinstance(x[0], bytes) else b"".join([ids[p] if isinstance(p, bytes) else p.to_bytes(4, "little") for p in x])
            self.held += 2 * len(c) + 200
        ids_of = self.known.__getitem__
        out = [b"".join(map(ids_of, chunks)) for chunks in chunked]
        if self.held > self.held_bytes:
            self.known, self.held = {}, 0
        return out


def _declared(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", block_bytes: int = BLOCK_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``docs`` with its text replaced by ``ids`` (binary: little-endian unsigned 32-bit numbers) and ``n_tokens``."""
    kept = docs.select([c for c in docs.columns if c not in (text, "ids", "n_tokens", "_raw")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(vocabulary), held_bytes)
        for batch in batches:
            for block in blocks(batch, "_raw", block_bytes):
                ids = encoder.encode(list(blobs(block.column("_raw"))))
                rest = block.drop_columns(["_raw"])
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=[*rest.schema.names, "ids", "n_tokens"])

    declared = ", ".join(x for x in (_declared(kept), "ids binary, n_tokens bigint") if x)
    return docs.select(*kept.columns, text_bytes(text).alias("_raw")).mapInArrow(run, declared)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``encoded`` with its ids replaced by ``decoded``: tokens joined by one blank, special ones included (the file names no decoder)."""
    kept = encoded.select([c for c in encoded.columns if c not in (ids, "decoded", "_ids")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = Vocabulary(vocabulary).tokens.__getitem__
        for batch in batches:
            for block in blocks(batch, "_ids", block_bytes):
                texts = [" ".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in blobs(block.column("_ids"))]
                rest = block.drop_columns(["_ids"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(texts, pa.string())], names=[*rest.schema.names, "decoded"])

    declared = ", ".join(x for x in (_declared(kept), "decoded string") if x)
    return encoded.select(*kept.columns, F.col(ids).alias("_ids")).mapInArrow(run, declared)
