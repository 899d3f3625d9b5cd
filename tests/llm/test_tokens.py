"""Byte-pair encoding by pair index against the tokenizers library, token for token."""

import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from stratafold.llm import pair_index_bpe as bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.file_of(bpe.VOCABULARY))


def ids_of(raw):
    return np.frombuffer(bytes(raw), "<u4").tolist()


def test_every_code_point_and_odd_texts(library):
    rng = random.Random(3)
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.VOCABULARY))
    texts = ["a" + chr(c) + "B's" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 11 == 0)]
    texts += ["".join(rng.choice("abAB<|endoftext|> \n\té'ÅΣςsst12३́\x1c\x85") for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    texts += ["<|endoftext|≯x<|startoftext|><|ENDOFTEXT|>", "", " \n ", "ab" * 20000, "a" * 30001]
    found = encoder.encode([t.encode() for t in texts])
    for text, own in zip(texts, found):
        assert ids_of(own) == library.encode(text, add_special_tokens=False).ids, text[:60]


@pytest.mark.parametrize("seed", range(6))
def test_merges_that_arise_below_the_current_rank(tmp_path, seed):
    """Vocabularies where a token has several merges, some of them late: order within a piece then matters."""
    rng = random.Random(seed)
    tokens = [c for c in bpe.byte_characters()] + [c + "</w>" for c in bpe.byte_characters()]
    merges, pool = [], ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
    while len(merges) < 60:
        a, b = rng.choice(pool), rng.choice(pool)
        if "</w>" not in a and [a, b] not in merges and len(a + b) < 16:
            merges.append([a, b])
            pool.append(a + b)
    rng.shuffle(merges)
    with open(bpe.file_of(bpe.VOCABULARY), encoding="utf-8") as file:
        whole = json.load(file)
    listed = list(dict.fromkeys([*tokens, *(a + b for a, b in merges)]))
    whole["model"] |= {"vocab": {t: i for i, t in enumerate(listed)}, "merges": merges}
    whole["added_tokens"] = []
    path = tmp_path / "own.json"
    path.write_text(json.dumps(whole))
    vocabulary, library = bpe.Vocabulary(str(path)), Tokenizer.from_file(str(path))
    assert any(v[3] for v in vocabulary.pairs.values())
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for many in (1, 48):
        for word, own in zip(words, bpe.merge_all([w.encode() for w in words], vocabulary, many)):
            assert ids_of(own) == library.encode(word, add_special_tokens=False).ids


def test_table_round_trip(make_docs, awkward, library):
    docs = make_docs(awkward).withColumnRenamed("lang", "ids")
    encoded = bpe.encode(docs, block_bytes=2000, held_bytes=4000)
    assert encoded.columns == ["doc_id", "source", "n_chars", "ids", "n_tokens"]
    rows = bpe.decode(encoded.selectExpr("*", "ids AS kept")).collect()
    assert len(rows) == len(awkward)
    texts = sorted((library.encode(t or "", add_special_tokens=False).ids for _, t in awkward))
    assert sorted(ids_of(r["kept"]) for r in rows) == texts
    for r in rows:
        assert r["n_tokens"] == len(r["kept"]) // 4
        assert r["decoded"] == library.decode(ids_of(r["kept"]), skip_special_tokens=False)


def test_empty_table_and_unknown_ids(spark, make_docs):
    empty = make_docs([(1, "x")]).where("doc_id = 2")
    assert bpe.decode(bpe.encode(empty)).collect() == []
    bad = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x00"))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="IndexError|index out of range"):
        bpe.decode(bad).collect()
