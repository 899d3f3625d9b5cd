"""The two passage operators against plain code over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.llm import collection_bwt, substring_dedup
from stratafold.llm.repeats import anchored_runs, text_keys


def covered(symbols: list, width: int) -> list[list[bool]]:
    seen = Counter(tuple(s[i:i + width]) for s in symbols for i in range(len(s) - width + 1))
    out = []
    for s in symbols:
        flags = [False] * len(s)
        for i in range(len(s) - width + 1):
            if seen[tuple(s[i:i + width])] > 1:
                flags[i:i + width] = [True] * width
        out.append(flags)
    return out


def results(docs, found, columns):
    keyed = docs.select("doc_id", *text_keys("text"))
    return sorted(map(tuple, keyed.join(found, ["k1", "k2"]).select("doc_id", *columns).collect()), key=repr)


@pytest.mark.parametrize("width, most", [(7, 20_000), (35, 20_000), (7, 1)])
def test_words(make_docs, awkward, width, most):
    docs = make_docs(awkward)
    found = substring_dedup.find_repeats(docs, width, most_contents=most)
    words = [(r[1] or "").encode().split() for r in awkward]
    want = []
    for (i, _), w, flags in zip(awkward, words, covered(words, width)):
        left = b" ".join(x for x, f in zip(w, flags) if not f)
        want.append((i, len(w), sum(flags), left.decode()))
    assert results(docs, found, ["n_words", "n_removed", "kept"]) == sorted(want, key=repr)


@pytest.mark.parametrize("width, most", [(40, 20_000), (400, 20_000), (40, 1)])
def test_bytes(make_docs, awkward, width, most):
    rows = [r for r in awkward if r[0] != 42]
    docs = make_docs(rows)
    found = collection_bwt.find_repeats(docs, width, most_contents=most).withColumn("sha", F.sha2("kept", 256))
    texts = [(r[1] or "").encode() for r in rows]
    want = []
    for (i, _), t, flags in zip(rows, texts, covered(texts, width)):
        left = bytes(x for x, f in zip(t, flags) if not f)
        spans = sum(f and not (k and flags[k - 1]) for k, f in enumerate(flags))
        want.append((i, len(t), sum(flags), spans, hashlib.sha256(left).hexdigest()))
    assert results(docs, found, ["n_bytes", "n_removed", "n_spans", "sha"]) == sorted(want, key=repr)


def test_removal_keeps_columns_and_nulls(make_docs, awkward):
    docs = make_docs(awkward).withColumn("kept", F.lit(1)).withColumn("ranges", F.lit("r"))
    for module in (substring_dedup, collection_bwt):
        out = module.remove_repeats(docs, 35)
        assert out.columns == docs.columns and out.count() == len(awkward)
        assert out.where("doc_id = 30").first()["text"] is None


def test_empty_table(make_docs):
    docs = make_docs([])
    assert substring_dedup.find_repeats(docs).count() == 0 and collection_bwt.find_repeats(docs).count() == 0


def test_suffix_order_against_sorting():
    rng = np.random.default_rng(1)
    for trial in range(150):
        sizes = rng.integers(0, 12, rng.integers(1, 7))
        symbols = rng.integers(1, 2 + trial % 3 + 1, sizes.sum())
        starts = np.cumsum(sizes) - sizes
        text, at, common = collection_bwt.suffix_order(symbols, starts, sizes, memory_bytes=0 if trial % 2 else 1 << 20)
        want = sorted(((*symbols[starts[i] + p:starts[i] + sizes[i]], i - 100), i, p) for i in range(len(sizes)) for p in range(sizes[i] + 1))
        assert [(i, p) for _, i, p in want] == list(zip(text.tolist(), at.tolist()))
        for k in range(1, len(want)):
            a, b = want[k - 1][0], want[k][0]
            same = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert same == common[k]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    shared = [rng.randrange(5) for _ in range(60)]
    width = 20
    a, b = ([rng.randrange(5) for _ in range(n)] + shared + [rng.randrange(5) for _ in range(30)] for n in (11, 37))
    marks = {}
    for s in (a, b):
        anchors, first, windows, lead = anchored_runs(np.array(s, np.uint64), width, 4)
        assert windows.sum() == len(s) - width + 1
        for h, f, w, x in zip(anchors.tolist(), first.tolist(), windows.tolist(), lead.tolist()):
            for i in range(f, f + w):
                assert marks.setdefault(tuple(s[i:i + width]), (h, f + x - i)) == (h, f + x - i)
