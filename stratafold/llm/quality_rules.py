"""Document quality by divergence from language references.

Each document gets two histograms: shares of character classes, and shares of its language's most common words with one
bin for all others. The references are the median class shares and the pooled word counts of all documents of a language
that pass the base rules. A document goes when its Jensen-Shannon distance to a reference exceeds the limit for its
length: short texts scatter more, so the limit widens with 1/sqrt(size), and below a least size a histogram is not
judged at all.

The references are a table that is joined to the documents by language, so their number is not bounded. A language with
fewer than ``min_docs`` passing documents has none: its documents are not judged by distance, only by the base rules.
NULL is a language of its own.

Edge cases: NULL and empty texts have no words, fail the base rules and are not kept. Repeated rows are judged one by
one and alike. An empty table gives an empty result. Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.common import arrow_batches, blocks, broadcast_if_small, encoded, text_bytes
from stratafold.session import cut

CLASSES = ("plain", "upper", "other_letter", "space", "line", "stop", "emphasis", "symbol", "control")
SYMBOLS = b"#*$%&|<>"
SHARE_STEPS = 500


@dataclass
class Reference:
    words: dict[bytes, int]
    word_share: np.ndarray
    class_share: np.ndarray


@dataclass(frozen=True)
class Limits:
    common_words: int = 100
    min_docs: int = 20
    min_chars: int = 60
    min_words: int = 40
    class_limit: float = 0.12
    class_slack: float = 0.7
    word_limit: float = 0.30
    word_slack: float = 2.6


def _class_table() -> np.ndarray:
    """Class of each byte; continuation bytes count nowhere (last bin).

    Digits count with the small letters: a number or a key in a short clean text is no sign of noise.
    """
    out = np.full(256, CLASSES.index("stop"))
    for lo, hi, name in ((97, 122, "plain"), (48, 57, "plain"), (65, 90, "upper"), (0, 31, "control"), (192, 255, "other_letter")):
        out[lo:hi + 1] = CLASSES.index(name)
    out[[32, 9]] = CLASSES.index("space")
    out[[10, 11, 12, 13]] = CLASSES.index("line")
    out[list(b"!?")] = CLASSES.index("emphasis")
    out[list(SYMBOLS)] = CLASSES.index("symbol")
    out[127] = CLASSES.index("control")
    out[128:192] = len(CLASSES)
    return out


CLASS_OF = _class_table()
#: Upper case to lower case, every other ASCII character except digits to a blank.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    grams = list(zip(*(words[i:] for i in range(width))))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    covered, end = 0, 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered += i + width - max(end, i)
            end = i + width
    return covered


def base_counts(text: bytes) -> tuple[int, int, int, int, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and characters by class."""
    words = text.split()
    classes = np.bincount(CLASS_OF[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1)[:-1]
    blanks = sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), int(classes.sum()) - blanks, int(classes[CLASSES.index("symbol")]), len(lines) - len(set(lines)),
            repeated_words(words), classes)


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence (base 2) of each row of ``p`` from the same row of ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.maximum(parts.sum(-1) / 2, 0))


def reference_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, kind, key, n over the documents that pass the base rules, summed per batch before the shuffle.

    Kind ``word`` counts occurrences of a word; ``docs`` and ``words`` are totals; ``c0``, ``c1``... count the documents whose share of
    a character class, in steps of 1/500, is the key.
    """
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("key", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str | None, tuple[Counter, Counter]] = {}
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("_bytes")):
                raw = value.as_py()
                n_words, _, _, _, repeated, chars = base_counts(raw)
                if fails_base(n_words, repeated):
                    continue
                words, other = by_lang.setdefault(name, (Counter(), Counter()))
                plain = raw.translate(PLAIN).split()
                words.update(plain)
                other["docs", b""] += 1
                other["words", b""] += len(plain)
                for i, x in enumerate(np.rint(SHARE_STEPS * chars / chars.sum()).astype(int).tolist()):
                    other[f"c{i}", b"%d" % x] += 1
            for name, (words, other) in by_lang.items():
                kinds = ["word"] * len(words) + [k for k, _ in other]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(kinds), pa.string()), pa.array(kinds, pa.string()),
                     pa.array([*words, *(k for _, k in other)], pa.binary()), pa.array([*words.values(), *other.values()], pa.int64())],
                    schema=schema)

    source = docs.select(F.col(lang).cast("string").alias("lang"), text_bytes(text).alias("_bytes"))
    parts = source.mapInArrow(run, "lang string, kind string, key binary, n bigint")
    return parts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, limits: Limits, text: str = "text", lang: str = "lang") -> DataFrame:
    """_lang, words (most common first), word_share (one more for all other words) and class_share of each language with a reference.

    A class share is the median over documents, so that odd ones do not move it.
    """
    schema = pa.schema([("_lang", pa.string()), ("words", pa.list_(pa.binary())), ("word_share", pa.list_(pa.float64())), ("class_share", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in schema.names}
            for name, listed in zip(batch.column("lang").to_pylist(), batch.column("rows")):
                rows = listed.as_py()
                if sum(r["n"] for r in rows if r["kind"] == "docs") < limits.min_docs:
                    continue
                common = [r for r in sorted(rows, key=lambda r: r["place"]) if r["kind"] == "word"]
                total = max(next(r["n"] for r in rows if r["kind"] == "words"), 1)
                held = np.array([r["n"] for r in common], float)
                share = np.zeros(len(CLASSES))
                for i in range(len(CLASSES)):
                    seen = sorted((int(r["key"]), r["n"]) for r in rows if r["kind"] == f"c{i}")
                    below = np.cumsum([n for _, n in seen])
                    share[i] = seen[int(np.searchsorted(below, below[-1] / 2))][0]
                out["_lang"].append(name)
                out["words"].append([r["key"] for r in common])
                out["word_share"].append((np.append(held, total - held.sum()) / total).tolist())
                out["class_share"].append((share / max(share.sum(), 1)).tolist())
            yield arrow_batches(out, schema)

    counts = reference_counts(docs, text, lang)
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")))
    # A class has at most 501 shares, so this limit is one of the words alone. Tasks apply it before the shuffle.
    found = ranked.where(F.col("place") <= max(SHARE_STEPS + 1, limits.common_words))
    found = found.where((F.col("kind") != "word") | (F.col("place") <= limits.common_words))
    listed = found.groupBy("lang").agg(F.collect_list(F.struct("kind", "key", "n", "place")).alias("rows"))
    return listed.mapInArrow(run, "_lang string, words array<binary>, word_share array<double>, class_share array<double>")


def apply_rules(docs: DataFrame, limits: Limits | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with base columns, ``class_distance``, ``word_distance`` (NULL where too short or without a reference) and ``kept``.

    Rows pass once, a few megabytes of text at a time.
    """
    limits = limits or Limits()
    refs = cut(references(docs, limits, text, lang)).select(F.col("_lang").alias("_ref_lang"), F.struct("words", "word_share", "class_share").alias("_ref"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    names = [c for c in docs.columns if c not in (*counts, "base_failed", "class_distance", "word_distance", "kept")]
    source = docs.select(*names, F.col(lang).cast("string").alias("_lang"), *([] if text in names else [F.col(text)]))
    joined = source.join(broadcast_if_small(refs), F.col("_lang").eqNullSafe(F.col("_ref_lang")), "left").drop("_ref_lang")

    def judge(batch: pa.RecordBatch, refs: dict) -> list[pa.Array]:
        size, raws = batch.num_rows, encoded(batch.column(text))
        found = [base_counts(raw) for raw in raws]
        judged = np.zeros(size, bool)
        chars = np.array([f[5] for f in found], float).reshape(size, len(CLASSES))
        hist, want = np.zeros((size, limits.common_words + 1)), np.zeros((size, limits.common_words + 1))
        ideal = np.zeros((size, len(CLASSES)))
        for i, (code, raw) in enumerate(zip(batch.column("_lang").to_pylist(), raws)):
            if code not in refs:
                one = batch.column("_ref")[i].as_py()
                refs[code] = one and Reference({w: k for k, w in enumerate(one["words"])}, np.array(one["word_share"]), np.array(one["class_share"]))
            ref = refs[code]
            if ref is None:
                continue
            judged[i] = True
            words = raw.translate(PLAIN).split()
            seen = Counter(words)
            for w, k in ref.words.items():
                hist[i, k] = seen.get(w, 0)
            hist[i, -1] = len(words) - hist[i].sum()
            want[i, :len(ref.words)] = ref.word_share[:-1]
            want[i, -1] = ref.word_share[-1]
            ideal[i] = ref.class_share
        n_words, n_chars = hist.sum(1), chars.sum(1)
        by_class = js_distance(chars / np.maximum(n_chars, 1)[:, None], ideal)
        by_word = js_distance(hist / np.maximum(n_words, 1)[:, None], want)
        judged_c, judged_w = judged & (n_chars >= limits.min_chars), judged & (n_words >= limits.min_words)
        bad = judged_c & (by_class > limits.class_limit + limits.class_slack / np.sqrt(np.maximum(n_chars, 1)))
        bad |= judged_w & (by_word > limits.word_limit + limits.word_slack / np.sqrt(np.maximum(n_words, 1)))
        failed = np.array([fails_base(f[0], f[4]) for f in found], bool)
        return [*(pa.array([f[i] for f in found], pa.int64()) for i in range(5)), pa.array(failed),
                pa.array(by_class, mask=~judged_c), pa.array(by_word, mask=~judged_w), pa.array(~failed & ~bad)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs: dict = {}
            for block in blocks(batch, text):
                yield pa.RecordBatch.from_arrays(
                    [*block.select(names).columns, *judge(block, refs)], names=[*names, *counts, "base_failed", "class_distance", "word_distance", "kept"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    added = ", ".join(f"{n} bigint" for n in counts) + ", base_failed boolean, class_distance double, word_distance double, kept boolean"
    return joined.mapInArrow(run, f"{kept}, {added}")
