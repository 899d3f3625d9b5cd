"""Conversation repair and the prefix trie: against plain code on small cases, against SQL on awkward tables."""

import itertools
import random
import re

import pytest

from compare import compare, connect
from stratafold.llm import conversation_repair as repair
from stratafold.llm.queries import QUERIES


def cheapest(symbols: str) -> tuple[int, str]:
    """All edits of a short sequence, with up to two insertions between rows."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    options = []
    for s in symbols:
        ways = [(3, "D", "")]
        if s != "d":
            more = 1 if s.isupper() else 0
            ways += [(more, "K", s.lower()), (2 + more, "R", "u"), (2 + more, "R", "a")]
        options.append([(cost + 2 * len(i), "I" * len(i) + edit, i + role) for cost, edit, role in ways for i in inserts])
    options.append([(2 * len(i), "I" * len(i), i) for i in inserts])
    for chosen in itertools.product(*options):
        if re.fullmatch("(s?(ua)+)?", "".join(c[2] for c in chosen)):
            way = (sum(c[0] for c in chosen), "".join(c[1] for c in chosen))
            best = way if best is None else min(best, way)
    return best


def test_repairs_are_the_cheapest_and_least():
    rng = random.Random(8)
    texts = [""] + ["".join(t) for t in itertools.product(repair.SYMBOLS, repeat=1)]
    texts += ["".join(rng.choice(repair.SYMBOLS) for _ in range(rng.randint(2, 3))) for _ in range(60)]
    found = repair.repairs([bytes(repair.SYMBOLS.index(c) for c in t) for t in texts])
    for text, own in zip(texts, found):
        assert own == cheapest(text), text


def test_grammar_spells_the_sequences():
    rng = random.Random(2)
    sequences = [bytes(rng.choice((0, 1, 1, 2, 2, 8)) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [bytes([1] * 33), bytes([1, 2] * 100)]
    packed, rules = repair.re_pair(sequences, 9)

    def spell(s):
        return [s] if s < 9 else [x for part in rules[s - 9] for x in spell(part)]

    assert [bytes(x for s in own for x in spell(s)) for own in packed] == sequences
    pairs = [p for own in packed for p in zip(own, own[1:])]
    once = {p for p in pairs if p[0] != p[1]}
    assert rules and len(once) == len([p for p in pairs if p[0] != p[1]])  # no pair is left twice


def test_ropes_compare_like_their_texts():
    rng = random.Random(4)
    ropes = [repair.rope(c) for c in "DIKR"]
    for _ in range(400):
        ropes.append(repair.joined(rng.choice(ropes), rng.choice(ropes)))
    ropes = [r for r in ropes if r[1] < 3000]
    for _ in range(3000):
        a, b = rng.choice(ropes), rng.choice(ropes)
        assert repair.before(a, b) == (repair.spelled(a) < repair.spelled(b))


def test_long_sequence_shares_rules():
    symbols = bytes(repair.SYMBOLS.index(c) for c in "uaUadx" * 20000)
    (cost, audit), = repair.repairs([symbols])
    assert len(audit.replace("I", "")) == len(symbols) and cost > 0


@pytest.fixture(scope="module")
def awkward_folder(spark, tmp_path_factory):
    """NULLs in every column, empty and blank texts, odd roles, one long conversation, copies, clashing extra columns."""
    rng = random.Random(6)
    rows = []
    for conv in range(260):
        shared = conv // 100 * 100
        for turn in range(rng.randint(1, 9)):
            text = rng.choice([f"Satz {shared} {turn}.", f"Frage {turn}?", "offen", "", " \t\n", "Gut!", f"{conv} eigen."])
            rows.append((conv, turn * rng.choice((1, 1, 1, 2)) + 10 * turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "Über"]), text, "x", conv))
    rows += [(300, t, ("user", "assistant")[t % 2], f"Zug {t % 7}." + " und mehr" * (t == 5) * 5000, "x", t) for t in range(700)]
    rows += [(301, None, None, None, None, None), (302, None, "user", None, None, 1), (302, 4, None, "Ja.", None, 1), (303, 9, "user", "allein.", "y", 2)]
    rows += [(400 + c, t, "user", f"gleich {t}.", "x", c) for c in range(40) for t in range(3)]
    rows += [(-7, 0, "user", "minus.", "x", 0), (None, 1, "user", "ohne Nummer.", "x", 0)]
    folder = str(tmp_path_factory.mktemp("conversations"))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string, depth long").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_prefix_trie"])
def test_awkward_tables(spark, awkward_folder, name):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{awkward_folder}/conversations.parquet/*.parquet')")
    compare(spark, con, *QUERIES[name], awkward_folder)


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_prefix_trie"])
def test_given_tables(spark, name):
    folder = "/root/testdata/sf0.001"
    compare(spark, connect(folder), *QUERIES[name], folder)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("op12_conversation_repair", "op13_prefix_trie"):
        assert QUERIES[name][0](spark, str(tmp_path)).collect() == []


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "a.", 0), (1, 1, "user", "b.", 0), (1, 2, "tool", "c.", 0), (1, 3, "tool", "c.", 0), (2, 0, "assistant", " ", 0)]
    found, fixed = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copy int"))
    assert {r["conv_id"]: r["audit"] for r in found.collect()} == {1: "KIKRD", 2: "D"}
    assert [tuple(r) for r in fixed.orderBy("conv_id", "place").collect()] == [
        (1, 0, "K", "user", "a."), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "b."), (1, 3, "R", "assistant", "c.")]
