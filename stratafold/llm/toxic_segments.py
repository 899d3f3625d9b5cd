"""Toxicity by maximum-scoring segments.

Token scores are log-odds of two classes under a chain of Dirichlet priors: a word's counts are added to pseudo-counts in
the proportion of its six-byte prefix, that one's to those of its five-byte prefix and so on, so inflected and unseen
words take their stem's odds. A token counts once for each different token after it, so copies of a text add nothing.
Tokens that say nothing, or repeat the one before, get a small negative score. One linear scan finds all maximal-scoring segments of a text. A
segment's score S in a text of n tokens has the expected number K n exp(-lambda S) by chance; lambda comes from the
scores of clean text, K from the best segments of clean texts. A document's evidence sums ln(1 / E) over its segments with E
under one; two logistic coefficients turn it into a probability.

Fitting uses at most ``sample_docs`` labelled documents of each class (in seeded hash order; a bounded sample), one half for
token scores under which the other half sets lambda, K and the coefficients; then the token scores are taken from both. Scoring covers all documents and whole texts.

Edge cases: NULL and empty texts have no segment and get the least probability. Repeated rows are scored alike. Labels
without a document, NULL labels and rows that are not for learning play no part; with one class or none every document
gets the share of toxic labels (0.5 without labels). An empty table gives an empty result. Input columns named like a
result column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.common import text_bytes

#: Upper case to lower case, every other ASCII character except digits to a blank.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
STEMS = (4, 5, 6)
SEGMENTS = "array<struct<start:bigint,end:bigint,score:double,expected:double>>"


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)  # a stem's name is the stem and a star
    neutral: float = -0.05
    decay: float = 1.0  # lambda
    scale: float = 1.0  # K
    intercept: float = 0.0
    slope: float = 0.0

    def weight(self, word: bytes) -> float:
        found = self.weights.get(word)
        for size in reversed(STEMS):
            if found is not None:
                return found
            if len(word) >= size:
                found = self.weights.get(word[:size] + b"*")
        return self.neutral if found is None else found

    def expected(self, score: float, n: int) -> float:
        return self.scale * n * math.exp(-min(self.decay * score, 700.0))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.intercept + self.slope * math.log1p(evidence)))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, sum), left to right, in linear time."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, the last earlier one with a lower sum before
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((start, end, low, high, j))
                break
            start, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def scan(text: bytes, model: Model, known: dict[bytes, float]) -> tuple[int, list[tuple[int, int, float]]]:
    words = text.translate(PLAIN).split()
    scores = np.empty(len(words))
    before = None
    for i, w in enumerate(words):
        s = known.get(w) if w != before else model.neutral
        if s is None:
            known[w] = s = model.weight(w)
        scores[i], before = s, w
    if len(known) > 200_000:  # a memo only
        known.clear()
    return len(words), maximal_segments(scores)


def evidence(n: int, segments: list[tuple[int, int, float]], model: Model) -> float:
    return sum(max(0.0, -math.log(model.expected(s, n))) for _, _, s in segments) if n else 0.0


def _sample(docs: DataFrame, labels: DataFrame, learn: Column, most: int, doc_id: str, label: str, text: str, seed: int) -> DataFrame:
    """doc_id, label, half, raw of at most ``most`` labelled documents of each class."""
    known = labels.where(F.col(label).isNotNull() & F.coalesce(learn, F.lit(True)))
    known = known.groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    drawn = known.withColumn("draw", F.xxhash64(F.lit(seed), doc_id)).withColumn("label", (F.col("label") > 0).cast("int"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw", doc_id))
    chosen = drawn.withColumn("place", place).where(F.col("place") <= most).select(
        F.col(doc_id).alias("_id"), "label", (F.col("place") % 2).alias("half"))
    return docs.select(F.col(doc_id).alias("_id"), text_bytes(text).alias("raw")).join(F.broadcast(chosen), "_id")  # at most 2 x most rows


def _token_weights(sample: DataFrame, model: Model, prior: float, least: int, distance: float) -> dict[bytes, float]:
    """Log-odds of the tokens and stems of a bounded sample that differ from what stands above them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, bytes, int]] = set()
            for raw, label in zip(batch.column("raw"), batch.column("label").to_pylist()):
                words = raw.as_py().translate(PLAIN).split()
                seen.update((label, w, xxhash.xxh3_64_intdigest(x) >> 1) for w, x in zip(words, [*words[1:], b""]))
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                                              pa.array([r[2] for r in rows], pa.int64())], names=["label", "word", "next"])

    pairs = sample.select("label", "raw").mapInArrow(run, "label int, word binary, next bigint").distinct()
    words = pairs.groupBy("word").agg(F.count(F.when(F.col("label") == 1, 1)).alias("n1"), F.count(F.when(F.col("label") == 0, 1)).alias("n0"))
    stems = [F.when(F.octet_length("word") >= s, F.concat(F.substring("word", 1, s), F.lit(b"*"))) for s in STEMS]
    node = F.explode(F.filter(F.array(F.col("word"), *stems), lambda x: x.isNotNull()))
    nodes = words.select(node.alias("node"), "n1", "n0").groupBy("node").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    totals = words.agg(F.sum("n1"), F.sum("n0")).first()
    if not totals[0] or not totals[1]:
        return {}
    scale1, scale0 = (totals[0] + totals[1]) / (2 * totals[0]), (totals[0] + totals[1]) / (2 * totals[1])
    counts = {bytes(r["node"]): (r["n1"], r["n0"]) for r in nodes.where(F.col("n1") + F.col("n0") >= least).collect()}  # of a bounded sample
    share: dict[bytes, float] = {}
    weights: dict[bytes, float] = {}
    for name in sorted(counts, key=lambda x: (not x.endswith(b"*"), len(x))):
        stem = name[:-1] if name.endswith(b"*") else name
        above = next((share[stem[:s] + b"*"] for s in reversed(STEMS) if s < len(stem) + (stem == name) and stem[:s] + b"*" in share), 0.5)
        n1, n0 = counts[name]
        share[name] = (n1 * scale1 + prior * above) / (n1 * scale1 + n0 * scale0 + prior)
        odds, up = (math.log(x / (1 - x)) for x in (share[name], above))
        if abs(odds) >= distance or abs(odds - up) >= distance:
            weights[name] = max(-2.0, min(8.0, odds)) if abs(odds) >= distance else model.neutral
    return weights


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, sample_docs: int = 6000, prior: float = 20.0, least: int = 3, distance: float = 1.5,
    doc_id: str = "doc_id", label: str = "toxic", text: str = "text", seed: int = 29,
) -> Model:
    sample = _sample(docs, labels, learn, sample_docs, doc_id, label, text, seed)
    model = Model()
    model.weights = _token_weights(sample.where("half = 0"), model, prior, least, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in batches:
            rows = [scan(raw.as_py(), model, known) for raw in batch.column("raw")]
            marks = [_histogram(raw.as_py(), model) for raw in batch.column("raw")]
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "n": [n for n, _ in rows], "segments": [[s for _, _, s in own] for _, own in rows],
                                              "values": [list(m) for m in marks], "counts": [list(m.values()) for m in marks]},
                                             schema=pa.schema([("label", pa.int32()), ("n", pa.int64()), ("segments", pa.list_(pa.float64())),
                                                               ("values", pa.list_(pa.float64())), ("counts", pa.list_(pa.int64()))]))

    kinds = "label int, n bigint, segments array<double>, values array<double>, counts array<bigint>"
    held = sample.where("half = 1").select("label", "raw").mapInArrow(run, kinds).collect()  # at most sample_docs rows
    toxic = sum(r["label"] for r in held)
    clean = [r for r in held if not r["label"] and r["n"]]
    if not model.weights or not toxic or not clean:
        share = min(max(toxic / len(held), 1e-3), 1 - 1e-3) if held else 0.5
        model.intercept = math.log(share / (1 - share))
        return model
    # lambda: the positive root of E exp(lambda s) = 1 over the tokens of clean texts.
    marks: dict[float, int] = {}
    for r in clean:
        for v, n in zip(r["values"], r["counts"]):
            marks[v] = marks.get(v, 0) + n
    s, n = np.array(list(marks)), np.array(list(marks.values()), float)
    low, high = 1e-3, 5.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (n * np.exp(middle * s)).sum() < n.sum() else (low, middle)
    model.decay = low
    best = np.array([max(r["segments"], default=0.0) for r in clean])
    model.scale = len(clean) / float((np.array([r["n"] for r in clean]) * np.exp(-model.decay * best)).sum())
    x = np.log1p([evidence(r["n"], [(0, 0, v) for v in r["segments"]], model) for r in held])
    model.intercept, model.slope = _logistic(x, np.array([r["label"] for r in held], float))
    model.weights = _token_weights(sample, model, prior, least, distance)
    return model


def _histogram(text: bytes, model: Model) -> dict[float, int]:
    out: dict[float, int] = {}
    for w in text.translate(PLAIN).split():
        v = model.weight(w)
        out[v] = out.get(v, 0) + 1
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton steps."""
    a = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2), design.T @ (y - p) - ridge * a)
        a += step
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0]), max(float(a[1]), 0.0)


def apply_model(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``segments`` (word positions, end exclusive, with an expected number under one), ``evidence`` and ``score``."""
    keep = [c for c in docs.columns if c not in ("segments", "evidence", "score")]
    # From a bounded sample. Plain values: a broadcast names its classes, and the executors may lack this package.
    shared = docs.sparkSession.sparkContext.broadcast(asdict(model))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Model(**shared.value), {}
        for batch in batches:
            lists, sums = [], []
            for raw in batch.column("_bytes"):
                n, found = scan(raw.as_py(), own, known)
                marked = [{"start": a, "end": b, "score": s, "expected": own.expected(s, n)} for a, b, s in found]
                lists.append([m for m in marked if m["expected"] < 1])
                sums.append(evidence(n, found, own))
            rest = batch.drop_columns(["_bytes"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(lists, kind), pa.array(sums, pa.float64()), pa.array([own.probability(e) for e in sums], pa.float64())],
                names=[*rest.schema.names, "segments", "evidence", "score"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select(*keep, text_bytes(text).alias("_bytes")).mapInArrow(run, f"{kept}segments {SEGMENTS}, evidence double, score double")
